"""Organisation type and link relevance."""

from pyspark.sql import Column, functions as F

from pagelens.functions import fixed_values as V, keywords, text


def _any_of(text: Column, words: list) -> Column:
    test = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(text, F.lit(word))
    return test


def entity(
    domain: Column, listed: Column | None = None, words: dict | None = None
) -> Column:
    """SCA-28: ``listed`` municipalities first, then keywords in fixed order.

    ``words`` (kind to keywords, in order) takes the place of the fixed ones;
    such a table may be of any size and is read in one pass.
    """
    name = text.strip(F.lower(domain))
    kind = F.lit("company")
    if words is None:
        for entity_type, known in reversed(V.ENTITY_KEYWORDS.items()):
            kind = F.when(_any_of(name, known), entity_type).otherwise(kind)
    else:
        # The first kind scores most, so it wins over those behind it.
        kinds = list(reversed(words))
        table = {w: i + 1 for i, k in enumerate(kinds) for w in words[k]}
        best = keywords.table_scores(name, table, {}, F.lit(""))
        kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), best - 1), kind) if kinds else kind
    if listed is None:
        return kind
    return F.when(listed, "municipality").otherwise(kind)


def _table_score(text: Column, table: dict) -> Column:
    """Highest score of the words found; words of equal score share a test."""
    score = F.lit(0)
    for value in sorted(set(table.values())):
        words = [w for w, v in table.items() if v == value]
        score = F.when(_any_of(text, words), value).otherwise(score)
    return score


def link_score(
    url: Column,
    entity_type: Column | str,
    base: dict | None = None,
    by_entity: dict | None = None,
) -> Column:
    """SCA-29 / AGG-10: best keyword score over the whole URL.

    The fixed tables of a few dozen words are substring tests inside the JVM.
    With tables of the user's own (``base``: word to score; ``by_entity``: the
    same for each organisation type) an automaton reads the URL once, whatever
    the number of words. Both give equal scores.

    The lower-cased URL is bound once as a lambda argument; as a plain
    subexpression it would be computed again for every keyword.
    """
    if base is not None or by_entity is not None:
        kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
        return keywords.table_scores(
            F.lower(url),
            V.BASE_SCORES if base is None else base,
            V.ENTITY_SCORES if by_entity is None else by_entity,
            kind,
        )

    def specific(text: Column) -> Column:
        if isinstance(entity_type, str):
            return _table_score(text, V.ENTITY_SCORES.get(entity_type, {}))
        score = F.lit(0)
        for name, table in V.ENTITY_SCORES.items():
            score = F.when(entity_type == name, _table_score(text, table)).otherwise(score)
        return score

    scored = F.transform(
        F.array(F.lower(url)),
        lambda text: F.greatest(_table_score(text, V.BASE_SCORES), specific(text)),
    )
    return F.get(scored, F.lit(0))
