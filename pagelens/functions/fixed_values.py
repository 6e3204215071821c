"""Word lists, tables, patterns and texts that results depend on.

Everything below must have exactly these values for results to be right; the
code that uses them lives elsewhere. Tables that users own (the municipality
list, public-suffix rules) are parameters and are not kept here.
"""

# --- addresses -------------------------------------------------------------
LOCAL_CHARS = r"[a-zA-Z0-9._%+\-]"
HOST_CHARS = r"[a-zA-Z0-9.\-]"
AT_WORDS = r"\[at\]|\(at\)|\s+at\s+"
PAYLOAD_PATTERN = (
    r"(?:data-cfemail\s*=\s*[\"']|/cdn-cgi/l/email-protection#)([0-9a-fA-F]{4,})"
)

# --- markup a reader cannot see --------------------------------------------
HIDDEN_STYLE = (
    r"display\s*:\s*none"
    r"|visibility\s*:\s*hidden"
    r"|opacity\s*:\s*0(?!\s*\.)(?!\d)"
    r"|font-size\s*:\s*0(?!\.[1-9])(?!\d)"
    r"|(?:width|height)\s*:\s*0(?:px)?\s*(?:;|$)"
    r"|text-indent\s*:\s*-\s*\d{3,}"
)
TEXT_COLOUR = r"(?<!-)\bcolor\s*:\s*([#\w(),.\s%]+?)\s*(?:;|$)"
BACK_COLOUR = r"\bbackground(?:-color)?\s*:\s*([#\w(),.\s%]+?)\s*(?:;|$)"
COLOUR_NAMES = {
    "#fff": "white",
    "#ffffff": "white",
    "#000": "black",
    "#000000": "black",
}

# --- responses that carry nothing readable ----------------------------------
MAX_WALL_CHARS = 2048
WALL_HEADERS = [
    ("cf-mitigated", "Cloudflare"),
    ("x-sucuri-block", "Sucuri"),
]
WALL_SIGNATURES = [
    ("/.well-known/sgcaptcha/", "SiteGround"),
    ("/.well-known/captcha/", "SiteGround"),
    ("cdn-cgi/challenge-platform", "Cloudflare"),
    ("__cf_chl", "Cloudflare"),
    ("just a moment", "Cloudflare"),
    ("_incapsula_resource", "Imperva"),
    ("ddos-guard", "DDoS-Guard"),
    ("sucuri_cloudproxy", "Sucuri"),
]
WALLS_PARTIAL = (
    "{n} pagina{plural} no se pudo leer{vendors}. "
    "Lo encontrado no cubre esa parte del sitio."
)
WALLS_TOTAL = (
    "Ninguna pagina se pudo leer{vendors}: el sitio respondio con un "
    "desafio anti-bot o una pagina vacia. El resultado no significa "
    "que el sitio no tenga correos."
)

# --- country evidence -------------------------------------------------------
RUT_CANDIDATE = r"\b(?:\d{1,2}(?:\.\d{3}){2}|\d{7,8})-[\dkK]\b"
LEXICON = [
    "rut",
    "comuna",
    "fono",
    "casilla",
    "giro",
    "clp",
    "pesos chilenos",
    "region metropolitana",
    "servicio de impuestos internos",
    "sociedad por acciones",
]
PATH_SEGMENT = r"(?i)^(?:cl|chile|es-cl)$|-cl$"
ZIP_PLUS_FOUR = r"\d{5}-\d{4}"
# Chilean numbering plan (public): area or service code, the digits that may
# follow it ("" for any), digits of the whole national number, kind.
COUNTRY_CODE = "56"
PHONE_PLAN = [
    ("2", "123", (9,), "fixed"),
    ("32", "", (9,), "fixed"),
    ("33", "", (9,), "fixed"),
    ("34", "", (9,), "fixed"),
    ("35", "", (9,), "fixed"),
    ("41", "", (9,), "fixed"),
    ("42", "", (9,), "fixed"),
    ("43", "", (9,), "fixed"),
    ("44", "", (9,), "voip"),
    ("45", "", (9,), "fixed"),
    ("51", "", (9,), "fixed"),
    ("52", "", (9,), "fixed"),
    ("53", "", (9,), "fixed"),
    ("55", "", (9,), "fixed"),
    ("57", "", (9,), "fixed"),
    ("58", "", (9,), "fixed"),
    ("61", "", (9,), "fixed"),
    ("63", "", (9,), "fixed"),
    ("64", "", (9,), "fixed"),
    ("65", "", (9,), "fixed"),
    ("67", "", (9,), "fixed"),
    ("71", "", (9,), "fixed"),
    ("72", "", (9,), "fixed"),
    ("73", "", (9,), "fixed"),
    ("75", "", (9,), "fixed"),
    ("9", "23456789", (9,), "mobile"),
    ("600", "", (10, 11), "shared_cost"),
    ("800", "", (9,), "toll_free"),
    ("1230", "", (11,), "toll_free"),
]
# Codes dialled before a country code: plain, or with one of the carriers.
DIAL_OUT = r"00|1(?:1[0-69]|2[0-5]|5[13-58]|69|7[0167]|8[018])0"

# --- person names and address patterns ---------------------------------------
NAME_WORD = r"[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{2,}"
FIRST_NAMES = [
    "Felipe", "Rodrigo", "Carlos", "Jorge", "Andrés", "Diego", "Luis",
    "Pablo", "Mario", "Francisco", "Alejandro", "Cristián", "Sebastián",
    "Claudio", "Ricardo", "Eduardo", "Gonzalo", "Marcelo", "Patricio",
    "Ignacio", "Tomás", "Nicolás", "Matías", "Bastián", "Javier",
    "María", "Ana", "Claudia", "Paula", "Carolina", "Andrea", "Verónica",
    "Gabriela", "Patricia", "Lorena", "Valeria", "Daniela", "Camila",
    "Javiera", "Francisca", "Catalina", "Isadora", "Constanza", "Sofía",
]
NAME_ACCENTS = ("áéíóúüñ", "aeiouun")
PATTERN_PRESETS = [
    ("first.last", "{first}.{last}"),
    ("flast", "{f}{last}"),
    ("f.last", "{f}.{last}"),
    ("first_last", "{first}_{last}"),
    ("last.first", "{last}.{first}"),
    ("lastf", "{last}{f}"),
    ("first", "{first}"),
]

# --- verification -------------------------------------------------------------
CATCH_ALL_PROBES = 2
ENHANCED_CODE = r"\b([245])\.(\d+)\.(\d+)\b"
GREYLIST_HINTS = [
    "greylist", "grey list", "graylist", "try again", "try later",
    "temporarily deferred", "deferred", "come back",
]
ERR_SYNTAX = "Invalid email format"
ERR_NO_MX = "No MX record: "
ERR_MX_LOOKUP = "MX lookup failed: "
ERR_SMTP = "SMTP error: "
ERR_RCPT = "SMTP RCPT code "
ERR_CATCH_ALL = (
    "Domain accepts all recipients; 250 is not proof the mailbox exists"
)
ERR_MAILBOX_FULL = (
    ": mailbox full, so it exists but will not take mail right now"
)
ERR_POLICY = (
    ": refused over policy, routing or protocol, "
    "which says nothing about this address"
)
ERR_GREYLISTED = " (greylisted, worth retrying)"
ERR_TIMED_OUT = "verification timed out"
MX_DOES_NOT_EXIST = " does not exist"
MX_NO_RECORDS = " has no MX and no A record"
MX_NULL = " publishes a null MX (RFC 7505): it accepts no mail"

# --- organisations and link scores ---------------------------------------------
ENTITY_KEYWORDS = {
    "municipality": [
        "muni", "municipio", "ilustre", "alcald", "gore", "gobernacion",
        "delegacion",
    ],
    "government": [
        "gob", "gov", "minsal", "minedu", "servel", "sii", "registro",
        "seremi", "intendencia", "ministerio", "subsecretaria", "dipres",
        "contraloria", "senado", "camara", "bcn",
    ],
    "university": [
        "edu", "univ", "uc", "udp", "usach", "uach", "ubb", "ufro",
        "utalca", "ucn", "uai", "udd", "pucv", "ucsc", "ulagos", "umag",
        "uantof",
    ],
}
BASE_SCORES = {
    "contacto": 10, "contact": 10, "directorio": 10, "staff": 9,
    "equipo": 8, "team": 8, "nosotros": 7, "about": 7, "quienes": 7,
    "personal": 5, "people": 5, "email": 5, "correo": 5,
}
ENTITY_SCORES = {
    "municipality": {
        "funcionarios": 10, "organigrama": 9, "transparencia": 9,
        "autoridades": 8, "alcaldia": 8, "concejo": 7, "secretaria": 7,
        "corporacion": 6, "direccion": 6, "departamento": 6, "unidades": 5,
        "oficinas": 5, "programas": 3, "servicios": 3, "tramites": 3,
    },
    "government": {
        "funcionarios": 10, "organigrama": 9, "transparencia": 9,
        "autoridades": 8, "estructura": 7, "departamento": 6,
        "oficinas": 5, "servicios": 3,
    },
    "university": {
        "academicos": 10, "facultad": 9, "departamento": 8, "escuelas": 7,
        "investigacion": 6, "postgrado": 6, "autoridades": 7, "decano": 8,
        "rector": 8, "carreras": 4,
    },
    "company": {
        "ejecutivos": 9, "directiva": 9, "liderazgo": 9, "leadership": 9,
        "management": 8, "gerencia": 8, "gerentes": 8, "empresa": 5,
        "organizacion": 5, "socios": 6, "partners": 6, "investors": 4,
        "relaciones": 4,
    },
}
MIN_LINK_SCORE = 3
SEARCH_QUERIES = {
    "municipality": [
        '"{domain}" directorio funcionarios email',
        '"{domain}" transparencia contacto correo',
        "site:{bare} correo email contacto funcionario",
    ],
    "government": [
        '"{domain}" directorio funcionarios email',
        "site:{bare} correo contacto email autoridades",
    ],
    "university": [
        '"{domain}" directorio academicos email',
        "site:{bare} correo email contacto facultad",
    ],
    "company": [
        '"{domain}" equipo directivo email contacto',
        "site:{bare} correo email staff ejecutivos",
        '"{domain}" contacto ejecutivos email',
    ],
}
HOST_QUERY = "site:{host} email correo contacto"
HOSTS_SCORED = 10
HOSTS_QUERIED = 3
MAX_SEEDS = 20

# --- regional target list ---------------------------------------------------------
TARGETS = [
    ("Cerrillos", "mcerrillos.cl"),
    ("Cerro Navía", "cerronavia.cl"),
    ("Conchalí", "conchali.cl"),
    ("El Bosque", "municipalidadelbosque.cl"),
    ("Estación Central", "municipalidaddeestacioncentral.cl"),
    ("Huechuraba", "huechuraba.cl"),
    ("Independencia", "independencia.cl"),
    ("La Cisterna", "cisterna.cl"),
    ("La Florida", "laflorida.cl"),
    ("La Granja", "municipalidadlagranja.cl"),
    ("La Pintana", "pintana.cl"),
    ("La Reina", "lareina.cl"),
    ("Las Condes", "lascondes.cl"),
    ("Lo Barnechea", "lobarnechea.cl"),
    ("Lo Espejo", "loespejo.cl"),
    ("Lo Prado", "loprado.cl"),
    ("Macul", "munimacul.cl"),
    ("Maipú", "municipalidadmaipu.cl"),
    ("Ñuñoa", "nunoa.cl"),
    ("Pedro Aguirre Cerda", "pedroaguirrecerda.cl"),
    ("Peñalolén", "penalolen.cl"),
    ("Providencia", "providencia.cl"),
    ("Pudahuel", "mpudahuel.cl"),
    ("Quilicura", "muniquilicura.cl"),
    ("Quinta Normal", "quintanormal.cl"),
    ("Recoleta", "recoleta.cl"),
    ("Renca", "renca.cl"),
    ("San Joaquín", "redsanjoaquin.cl"),
    ("San Miguel", "sanmiguel.cl"),
    ("San Ramón", "municipalidadsanramon.cl"),
    ("Santiago", "munistgo.cl"),
    ("Vitacura", "vitacura.cl"),
    ("Puente Alto", "mpuentealto.cl"),
    ("Pirque", "pirque.cl"),
    ("San José de Maipo", "sanjosedemaipo.cl"),
    ("Colina", "colina.cl"),
    ("Lampa", "lampa.cl"),
    ("Tiltil", "tiltil.cl"),
    ("San Bernardo", "sanbernardo.cl"),
    ("Buin", "buin.cl"),
    ("Paine", "paine.cl"),
    ("Calera de Tango", "municaleradetango.cl"),
    ("Melipilla", "melipilla.cl"),
    ("Alhué", "municipalidadalhue.cl"),
    ("Curacaví", "municipalidadcuracavi.cl"),
    ("María Pinto", "mpinto.cl"),
    ("San Pedro", "munisanpedro.cl"),
    ("Talagante", "munitalagante.cl"),
    ("El Monte", "munielmonte.cl"),
    ("Isla de Maipo", "islademaipo.cl"),
    ("Padre Hurtado", None),
    ("Peñaflor", "penaflor.cl"),
    ("ACHM", "achm.cl"),
]
# Domains of all municipalities; the regional targets are among them.
MUNICIPALITIES = [
    "municipalidadalgarrobo.cl", "municipalidadalhue.cl", "munialtobiobio.cl",
    "munialtodelcarmen.cl", "maho.cl", "muniancud.cl", "andacollochile.cl", "angol.cl",
    "municipalidadantofagasta.cl", "municipalidadantuco.cl", "muniarauco.cl", "muniarica.cl",
    "puertoaysen.cl", "buin.cl", "imb.cl", "municipiocabildo.cl", "imcabodehornos.cl",
    "cabrero.cl", "municipalidadcalama.cl", "municipalidadcalbuco.cl", "caldera.cl",
    "municaleradetango.cl", "municallelarga.cl", "municamarones.cl", "municipalidaddecamina.cl",
    "canela.cl", "municanete.cl", "carahue.cl", "municipalidaddecartagena.cl",
    "municipalidadcasablanca.cl", "castromunicipio.cl", "municatemu.cl", "cauquenes.cl",
    "mcerrillos.cl", "cerronavia.cl", "municipalidadchaiten.cl", "munichanaral.cl", "chanco.cl",
    "municipalidadchepica.cl", "chiguayante.cl", "chilechico.cl", "municipalidadchillan.cl",
    "chillanviejo.cl", "municipalidadchimbarongo.cl", "municholchol.cl",
    "municipalidadchonchi.cl", "municipalidadcisnes.cl", "cobquecura.cl", "municochamo.cl",
    "municochrane.cl", "municipalidaddecodegua.cl", "municipalidaddecoelemu.cl", "coyhaique.cl",
    "municoihueco.cl", "municoinco.cl", "municipalidadcolbun.cl", "imcolchane.cl", "colina.cl",
    "municipalidadcollipulli.cl", "coltauco.cl", "combarbala.cl", "concepcion.cl",
    "conchali.cl", "concon.cl", "constitucion.cl", "contulmo.cl", "copiapo.cl",
    "municoquimbo.cl", "coronel.cl", "municipalidadcorral.cl", "municunco.cl", "mcuracautin.cl",
    "municipalidadcuracavi.cl", "curacodevelez.cl", "munichue.cl", "curarrehue.cl",
    "curepto.cl", "curico.cl", "munidalcahue.cl", "imda.cl", "mdonihue.cl",
    "municipalidadelbosque.cl", "municipalidadelcarmen.cl", "munielmonte.cl", "elquisco.cl",
    "eltabo.cl", "empedrado.cl", "muniercilla.cl", "municipalidaddeestacioncentral.cl",
    "muniflorida.cl", "munifreire.cl", "imfreirina.cl", "munifresia.cl", "munifrutillar.cl",
    "futaleufu.cl", "munifutrono.cl", "galvarinochile.cl", "portalvisviri.cl",
    "municipalidadgorbea.cl", "municipalidadgraneros.cl", "muniguaitecas.cl", "hijuelas.cl",
    "municipalidadhualaihue.cl", "hualane.cl", "hualpenciudad.cl", "munihualqui.cl",
    "imhuara.cl", "imhuasco.cl", "huechuraba.cl", "municipalidadillapel.cl", "independencia.cl",
    "municipioiquique.cl", "islademaipo.cl", "rapanui.net", "comunajuanfernandez.cl",
    "lacalera.cl", "cisterna.cl", "lacruz.cl", "munilaestrella.cl", "laflorida.cl",
    "municipalidadlagranja.cl", "munilahiguera.cl", "laligua.cl", "pintana.cl", "lareina.cl",
    "laserena.cl", "munilaunioninfo.com", "municipalidadlagoranco.cl", "lagoverdeaysen.cl",
    "mlagunablanca.cl", "munilaja.cl", "lampa.cl", "munilanco.cl", "lascabrasmunicipalidad.cl",
    "lascondes.cl", "munilautaro.cl", "lebu.cl", "mlicanten.cl", "limache.cl",
    "corporacionlinares.cl", "litueche.cl", "llanquihue.cl", "municipalidadllayllay.cl",
    "lobarnechea.cl", "loespejo.cl", "loprado.cl", "munilolol.cl", "municipalidaddeloncoche.cl",
    "municipalidadlongavi.cl", "mlonquimay.cl", "municipalidadlosalamos.cl", "losandes.cl",
    "losangeles.cl", "muniloslagos.cl", "muermos.cl", "munilossauces.com", "munilosvilos.cl",
    "lota.cl", "munilumaco.cl", "machali.cl", "munimacul.cl", "munimafil.cl",
    "municipalidadmaipu.cl", "comunamalloa.cl", "marchigue.cl", "imme.cl", "mpinto.cl",
    "munimariquina.cl", "comunademaule.cl", "munimaullin.cl", "mejillones.cl", "melipeuko.cl",
    "melipilla.cl", "web.molina.cl", "munimontepatria.cl", "mostazal.cl", "munimulchen.cl",
    "nacimiento.cl", "municipalidadnancagua.cl", "muninatales.cl", "muninavidad.cl",
    "muninegrete.cl", "muniniquen.cl", "munininhue.cl", "muninogales.cl", "nuevaimperial.cl",
    "nunoa.cl", "municipalidadohiggins.cl", "muniolivar.cl", "municipalidadollague.cl",
    "muniolmue.cl", "municipalidadosorno.cl", "municipalidadovalle.cl", "mph.cl",
    "padrelascasas.cl", "municipalidaddepaihuano.cl", "munipaillaco.cl", "paine.cl",
    "municipalidadpalena.cl", "munipalmilla.cl", "municipalidadpanguipulli.cl",
    "impanquehue.cl", "municipalidadpapudo.cl", "comunaparedones.cl", "parral.cl",
    "pedroaguirrecerda.cl", "pelarco.cl", "munipelluhue.cl", "munipemuco.cl", "penaflor.cl",
    "penalolen.cl", "mpencahue.cl", "penco.cl", "muniperalillo.cl", "perquenco.cl",
    "munipetorca.com", "mpeumo.cl", "municipalidadpica.cl", "pichidegua.cl", "pichilemu.cl",
    "municipalidaddepinto.cl", "pirque.cl", "mpitrufquen.cl", "muniplacilla.cl",
    "municipalidaddeportezuelo.cl", "muniporvenir.cl", "impa.gob.cl",
    "municipalidaddeprimavera.cl", "providencia.cl", "munipuchuncavi.cl",
    "municipalidadpucon.cl", "mpudahuel.cl", "mpuentealto.cl", "puertomontt.cl",
    "munipuertoctay.cl", "ptovaras.cl", "munipumanque.cl", "munipunitaqui.cl", "puntaarenas.cl",
    "munipuqueldon.cl", "munipuren.cl", "purranque.cl", "putaendo.cl", "imputre.cl",
    "municipalidaddepuyehue.cl", "muniqueilen.cl", "muniquellon.cl", "muniquemchi.cl",
    "municipalidadquilaco.cl", "muniquilicura.cl", "municipalidadquilleco.cl", "quillota.cl",
    "quilpue.cl", "municipalidadquinchao.cl", "quintadetilcoco.cl", "quintanormal.cl",
    "muniquintero.cl", "municipalidadquirihue.cl", "rancagua.cl", "municipalidadranquil.cl",
    "munirauco.cl", "recoleta.cl", "renaico.cl", "renca.cl", "municipalidadrengo.cl",
    "requinoa.cl", "retiro.cl", "munirinconada.cl", "municipalidadderiobueno.cl", "rioclaro.cl",
    "riohurtado.cl", "rioibanez.cl", "rionegrochile.cl", "rioverde.cl", "muniromeral.cl",
    "municipiodesaavedra.cl", "sagradafamilia.cl", "salamanca.cl", "sanantonio.cl",
    "sanbernardo.cl", "sancarlos.cl", "sanclemente.cl", "munisanesteban.cl", "sanfabian.cl",
    "munisanfelipe.cl", "munisanfernando.cl", "sangregorio.cl", "munisanignacio.cl",
    "imsanjavier.cl", "redsanjoaquin.cl", "sanjosedemaipo.cl", "sanjuandelacosta.cl",
    "sanmiguel.cl", "municipalidadsannicolas.cl", "sanpablo.cl", "munisanpedro.cl",
    "sanpedroatacama.com", "sanpedrodelapaz.cl", "munisanrafael.cl", "municipalidadsanramon.cl",
    "municipalidadsanrosendo.cl", "municipalidadsanvicente.cl", "santabarbara.cl",
    "municipalidadsantacruz.cl", "santajuana.cl", "imsantamaria.com", "munistgo.cl",
    "santodomingo.cl", "municipalidadsierragorda.cl", "munitalagante.cl", "talca.cl",
    "talcahuano.cl", "municipalidadtaltal.cl", "temuco.cl", "teno.cl", "muniteodoro.cl",
    "tierramarilla.com", "tiltil.cl", "municipalidadtimaukel.cl", "munitirua.com",
    "imtocopilla.cl", "tolten.cl", "tome.cl", "torresdelpayne.cl", "municipalidaddetortel.cl",
    "mtraiguen.cl", "trehuaco.com", "municipalidadtucapel.cl", "munivaldivia.cl", "vallenar.cl",
    "web.municipalidaddevalparaiso.cl", "munivichuquen.cl", "victoriachile.cl",
    "municipalidadvicuna.cl", "vilcun.cl", "villalegre.cl", "villalemana.cl", "villarrica.org",
    "vinadelmarchile.cl", "vitacura.cl", "muniyerbasbuenas.cl", "yumbel.cl", "yungay.cl",
    "munizapallar.cl",
]
DOMAIN_PATTERNS = [
    "municipalidad{slug}.cl",
    "muni{slug}.cl",
    "{slug}.cl",
    "im{slug}.cl",
    "m{slug}.cl",
]
SLUG_ACCENTS = ("áéíóúñ", "aeioun")

# --- reports -------------------------------------------------------------------
STATUSES = ["valid", "catch_all", "unknown", "invalid"]
ROW_LABELS = {
    "valid": "Válido",
    "catch_all": "Acepta todo",
    "unknown": "Desconocido",
    "invalid": "Inválido",
}
NO_EVIDENCE = "sin evidencia"
GENERATED_MARK = "generado"
HIDDEN_MARK = "oculto"
HTML_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
]
OUTPUT_FORMATS = {"csv": "csv", "json": "json", "html": "html", "htm": "html"}
YIELD_GATE = 0.65
Z_95 = 1.96
SESSIONS_KEPT = 10
