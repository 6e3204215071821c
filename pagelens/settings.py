"""Session settings the jobs are written for."""

SETTINGS = {
    # Runtime plans: joins broadcast by measured size, hot join keys split,
    # small shuffle partitions merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # A split of page text is parsed in seconds; more splits than cores keep the
    # cluster even without shuffling any text.
    "spark.sql.files.maxPartitionBytes": "32MB",
    # Observations and reports are compared as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Checkpointed rounds are removed when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Seen addresses of a long stream live on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(builder, shuffle_partitions: int, checkpoint_dir: str | None = None):
    """Apply the settings to a session builder.

    ``shuffle_partitions`` is the count before adaptive merging: a few per
    core of the cluster, so that 100 TB of pages gives partitions that fit in
    memory. ``checkpoint_dir`` must be a folder all executors share; leave it
    out where the cluster already names one.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder
