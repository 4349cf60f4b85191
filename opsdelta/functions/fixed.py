"""Names, tables, thresholds and patterns that results depend on.

They are stated plainly because a different value would give a different
answer; nothing in this module computes.
"""

# Severities in rank order, with the points each one deducts.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_POINTS = {"CRITICAL": 45, "HIGH": 25, "MEDIUM": 10, "LOW": 4, "INFO": 0}

# Confidence bands, lowest confidence of each.
CONFIDENCE_BANDS = [(0.9, "VERY_HIGH"), (0.75, "HIGH"), (0.5, "MODERATE"), (0.25, "LOW")]

# Health categories and their weights.
CATEGORY_WEIGHTS = {
    "PERFORMANCE": 25,
    "SECURITY": 25,
    "RELIABILITY": 15,
    "DEPENDENCIES": 15,
    "CONFIGURATION": 10,
    "INTEGRITY": 10,
}
# Severity -> (capped score, least confidence that triggers it).
SCORE_CAPS = {"CRITICAL": (40, 0.5), "HIGH": (75, 0.75)}
# Categories a plain scan can score.
SCORED_CATEGORIES = ["PERFORMANCE", "DEPENDENCIES", "CONFIGURATION"]

# Rule catalog (rule, category, default severity).
RULE_CATALOG = [
    ("CFG-MANIFEST-001", "CONFIGURATION", "MEDIUM"),
    ("CFG-MISSING-FILE-001", "CONFIGURATION", "HIGH"),
    ("CFG-ENSURE-MISSING-001", "CONFIGURATION", "HIGH"),
    ("DEP-MISSING-001", "DEPENDENCIES", "HIGH"),
    ("DEP-CYCLE-001", "DEPENDENCIES", "MEDIUM"),
    ("PERF-LOOP-001", "PERFORMANCE", "MEDIUM"),
    ("PERF-EVENT-001", "PERFORMANCE", "MEDIUM"),
    ("PERF-QUERY-001", "PERFORMANCE", "MEDIUM"),
    ("PERF-REGRESSION-001", "PERFORMANCE", "HIGH"),
    ("SEC-SECRET-001", "SECURITY", "HIGH"),
    ("SEC-WEBHOOK-001", "SECURITY", "MEDIUM"),
    ("SEC-OBFUSCATION-001", "SECURITY", "MEDIUM"),
    ("SEC-REMOTE-LOAD-001", "SECURITY", "HIGH"),
    ("SEC-DYNAMIC-EXEC-001", "SECURITY", "MEDIUM"),
    ("SEC-SUSPICIOUS-FILE-001", "SECURITY", "MEDIUM"),
    ("INT-CHANGE-001", "INTEGRITY", "INFO"),
]

# Signal kinds that describe a change, and ones that describe harm.
CHANGE_KINDS = ["RESOURCE_CHANGED", "RESOURCE_ADDED", "RESOURCE_REMOVED", "CONFIG_CHANGED", "RESOURCE_RESTART"]
EFFECT_KINDS = ["PERFORMANCE_REGRESSION", "FINDING_INTRODUCED", "HEALTH_DROP", "ERROR_SPIKE", "HITCH"]

# Resources that ship with the server data set.
BUNDLED_RESOURCES = [
    "baseevents",
    "runcode",
    "mapmanager",
    "spawnmanager",
    "player-data",
    "playernames",
    "chat-theme-example",
    "basic-gamemode",
    "example-loadscreen",
]

# Manifest versions and games that are recognised.
KNOWN_FX_VERSIONS = ["cerulean", "bodacious", "adamant"]
KNOWN_GAMES = ["gta5", "rdr3", "common"]

# Configuration commands.
RESOURCE_COMMANDS = ["ensure", "start", "stop", "restart"]
VARIABLE_COMMANDS = ["set", "sets", "setr"]

# File extension -> file type.
FILE_TYPES = {
    "lua": "lua",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "javascript",
    "json": "json",
    "cfg": "config",
    "ini": "config",
    "toml": "config",
    "yml": "config",
    "yaml": "config",
    "html": "web",
    "css": "web",
    "dll": "binary",
    "exe": "binary",
    "so": "binary",
    "dylib": "binary",
}

# Suspicious extensions by kind, with the confidence of each kind.
SUSPICIOUS_FILES = [
    ("EXECUTABLE", 0.9, [".exe", ".msi", ".scr", ".com"]),
    ("HOST_SCRIPT", 0.8, [".bat", ".cmd", ".ps1", ".sh", ".vbs"]),
    ("ARCHIVE", 0.4, [".zip", ".rar", ".7z", ".tar", ".gz"]),
    ("NATIVE_MODULE", 0.35, [".dll", ".so", ".dylib", ".node", ".jar"]),
    ("DATABASE", 0.3, [".db", ".sqlite", ".sqlite3", ".mdb"]),
]

# Calls the execution rules look for.
FETCH_CALLS = ["PerformHttpRequest", "Citizen.InvokeNative", "exports.http:request", "http.request", "fetch"]
LOADER_CALLS = ["load", "loadstring", "RunString", "dofile", "require"]
FILE_WRITE_CALLS = ["SaveResourceFile", "io.open", "io.write"]
EXECUTABLE_TARGET = r"(?i)\.(?:exe|dll|so|dylib|bat|cmd|ps1|sh|scr|vbs|jar)$"
DATABASE_PREFIXES = [
    "MySQL.",
    "MySQL:",
    "exports.oxmysql:",
    "exports.ghmattimysql:",
    "exports.mysql-async:",
    "Oxmysql.",
    "oxmysql.",
]

# Obfuscation indicators and weights.
OBFUSCATION_WEIGHTS = {
    "DECODE_CHAIN": 0.45,
    "ENCODED_STRING_DENSITY": 0.3,
    "OPAQUE_IDENTIFIERS": 0.25,
    "CHARACTER_RECONSTRUCTION": 0.2,
    "ESCAPED_STRING_DENSITY": 0.2,
    "LONG_SINGLE_LINE": 0.1,
}

# Retention in days per table.
RETENTION_DAYS = {
    "performance_samples": 30,
    "scan_runs": 90,
    "incidents": 180,
    "integrity_snapshots": 90,
}

# Telemetry document versions that are understood, and the name
# a document without a collector gets.
TELEMETRY_VERSIONS = ["1.0"]
DEFAULT_COLLECTOR = "collector"
SERVER_SCOPE = "(server)"

# Redaction mask and patterns. `NB` and `NA` stand for the ASCII
# word boundary, spelled out because Java's \b also counts accented letters.
# Values and key prefixes of any length are masked whole: a bound would leave
# the rest of a long secret readable.
MASK = "********"
NB = r"(?<![A-Za-z0-9_])"
NA = r"(?![A-Za-z0-9_])"
KEY_PREFIX = "(?:[A-Za-z0-9]+[_.-]?)?"
SENSITIVE_NAME = (
    "(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?token"
    "|authorization|credential|licen[cs]e[_-]?key|webhook[_-]?url|connection[_-]?string|db[_-]?pass)"
)
SENSITIVE_KEY = KEY_PREFIX + SENSITIVE_NAME
REDACTIONS = [
    # (name, pattern, replacement)
    (
        "discord-webhook",
        r"(?i)(https?://(?:[a-z0-9-]+\.)?discord(?:app)?\.com/api/(?:v\d+/)?webhooks/)[\w-]+/[\w-]+",
        "$1" + MASK,
    ),
    ("generic-webhook", r"""(?i)(https?://[^\s"'`]*)/webhooks?/[A-Za-z0-9_\-/]{16,}""", "$1/webhook/" + MASK),
    (
        "private-key-block",
        r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]*?"
        r"-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
        f"-----BEGIN PRIVATE KEY-----{MASK}-----END PRIVATE KEY-----",
    ),
    # starts only where a run of scheme characters starts, so long runs cost one pass
    (
        "uri-credentials",
        r"""(?i)((?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s:/@"']+):([^\s@"'/]+)@""",
        f"$1:{MASK}@",
    ),
    (
        "authorization-header",
        r"""(?i)(authorization\s*+[:=]\s*+["']?\s*+(?:bearer|basic|token)\s++)([\w.~+/=-]{8,})""",
        "$1" + MASK,
    ),
    ("jwt", NB + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}" + r"(?<=[A-Za-z0-9_])" + NA, MASK),
    (
        "discord-bot-token",
        NB + r"(?=[A-Za-z0-9_])[A-Za-z0-9_-]{23,28}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,40}(?<=[A-Za-z0-9_])" + NA,
        MASK,
    ),
    (
        "sensitive-assignment",
        # what precedes the name is kept as it is, so the match may start at the name
        "(?i)(" + SENSITIVE_NAME + "[\"'`]?\\s*+(?:=|:|=>)\\s*+)([\"'`])([^\"'`\\n]++)(\\2)",
        f"$1$2{MASK}$2",
    ),
    (
        "sensitive-assignment-unquoted",
        "(?i)(" + NB + SENSITIVE_KEY + "\\s*(?:=|:)(?![=>])\\s*)([^\\s\"'`;,)]++)",
        "$1" + MASK,
    ),
]
