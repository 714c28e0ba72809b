"""Fixed values.

Everything in this module must equal the reference behaviour for results to agree:
allowed labels, stop words, patterns, limits, confidences and rank tables.
"""

from __future__ import annotations

# -- allowed labels -----------------------------------------------------------
RISK_LEVELS = ["High", "Low", "Medium", "Unknown"]
SEVERITIES = ["High", "Low", "Medium"]
STATUSES = ["Closed", "In Progress", "Monitoring", "Open"]
CONTRADICTION_TYPES = [
    "Compliance Conflict", "Maintenance Conflict", "Operational Conflict",
    "Risk Conflict", "Sensor Conflict", "Unknown",
]
ENTITY_TYPES = [
    "Audit Status", "Document Date", "Equipment", "Failure Mode", "Historian Signal",
    "Inspection Date", "Location", "Maintenance Activity", "PPE Requirement",
    "Permit Control", "Person", "Process Parameter", "Regulation", "Safety Hazard",
    "Spare Part", "Work Order",
]
PAYLOAD_ARRAYS = ["entities", "assets", "timeline_events", "compliance_gaps", "contradictions"]
PAYLOAD_WRAPPERS = ["analysis", "result", "data", "output"]

# -- ranks --------------------------------------------------------------------
RISK_RANK = {"Unknown": 0, "Low": 1, "Medium": 2, "High": 3}
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
STATUS_RANK = {"Closed": 0, "Monitoring": 1, "In Progress": 2, "Open": 3}
SEVERITY_ORDER = {"High": 1, "Medium": 2, "Low": 3}
EVENT_TYPE_RANK = {"Incident": 5, "Historian Signal": 4, "Inspection": 3, "Service": 2, "Work Order": 1}
VALIDATION_RANK = {"accepted": 3, "weak": 2, "rejected": 1}

# -- patterns -----------------------------------------------------------------
# Unicode white space as the reference splits on it.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
IDENTIFIER = (
    r"(?i)\b[A-Z]{1,8}-\d+[A-Z0-9-]*\b"
    r"|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d+(?:\.\d+)?\s*(?:MM/S|DAYS?|DAY)\b"
)
TOKEN = r"[a-z0-9]+(?:[-./][a-z0-9]+)*"
IDENTIFIER_TERM = r"\A(?:[a-z]{1,8}-\d+[a-z0-9-]*|\d+(?:\.\d+)?)\z"
ASSET_ID = r"\A[A-Z0-9][A-Z0-9_.-]{1,79}\z"
# ISO 8601 dates (calendar and week, extended and basic) with an optional time and zone.
ISO_CLOCK = (
    r"([T ]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d{1,9})?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d)?)?)?)?\z"
)
ISO_DATE = r"\A(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(-?[1-7])?)" + ISO_CLOCK
# Spellings of a number in the model answers' language; Java's suffixes and hexadecimals are none.
NUMBER = r"(?i)\A\s*[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*\z"

# -- stop words ---------------------------------------------------------------
EVIDENCE_STOP_WORDS = (
    "a an and are as at be before but by due for from has in is it not of on or the to under was with"
).split()
RETRIEVAL_STOP_WORDS = (
    "a after all and are as at be before by does for from has in is it must of on or should the to "
    "what when where which why with"
).split()

# -- evidence predicate -------------------------------------------------------
MIN_TOKENS_WITHOUT_IDENTIFIER = 4
MIN_TOKEN_OVERLAP = 0.6

# -- limits -------------------------------------------------------------------
CHUNK_WORDS, CHUNK_OVERLAP = 130, 25
RETRIEVAL_CHUNK_WORDS, RETRIEVAL_CHUNK_OVERLAP = 90, 20
BATCH_CHARACTERS, BATCH_CHARACTERS_MIN, BATCH_CHARACTERS_MAX = 12_000, 2_000, 50_000
TOP_CHUNKS = 6
TOP_CITATIONS = 4
TOP_RELATED = 12
TOP_PATHS = 3
TOP_EVENTS = 4
TOP_GAPS = 3
TOP_EDGES = 12
ITEM_CITATIONS = 2
RECENT_DOCUMENTS = 5
DOCUMENT_PREVIEW, ENTITY_PREVIEW = 8, 18
PATH_EVIDENCE = 8
EMBEDDING_DIM = 384

# -- retrieval weights --------------------------------------------------------
FILENAME_WEIGHT, IDENTIFIER_WEIGHT, BIGRAM_WEIGHT = 0.5, 2.0, 1.25

# -- edges --------------------------------------------------------------------
ACCEPT_CONFIDENCE = 0.7
EDGE_CONFIDENCE = {"location": 0.72, "event": 0.86, "document": 0.58, "gap": 0.9, "contradiction": 0.82}
ENTITY_EDGE_LABELS = {
    "Audit Status": "EQUIPMENT_HAS_AUDIT_STATUS",
    "Document Date": "EQUIPMENT_HAS_DOCUMENT_DATE",
    "Failure Mode": "EQUIPMENT_HAS_FAILURE",
    "Historian Signal": "EQUIPMENT_HAS_HISTORIAN_SIGNAL",
    "Inspection Date": "EQUIPMENT_HAS_INSPECTION_DATE",
    "Location": "EQUIPMENT_LOCATED_IN",
    "Maintenance Activity": "EQUIPMENT_HAS_MAINTENANCE_ACTIVITY",
    "Permit Control": "PROCEDURE_REQUIRES_PERMIT_CONTROL",
    "Person": "EQUIPMENT_HAS_PERSON_REFERENCE",
    "PPE Requirement": "PROCEDURE_REQUIRES_PPE",
    "Process Parameter": "EQUIPMENT_HAS_PROCESS_PARAMETER",
    "Regulation": "PROCEDURE_REFERENCES_REGULATION",
    "Safety Hazard": "EQUIPMENT_EXPOSED_TO_HAZARD",
    "Spare Part": "MAINTENANCE_USES_SPARE",
    "Work Order": "EQUIPMENT_HAS_WORK_ORDER",
}
DEFAULT_ENTITY_EDGE = "EQUIPMENT_RELATED_TO_ENTITY"
REASON_REJECTED = "Relationship is missing a source document or evidence snippet."
REASON_ACCEPTED = "Relationship has source evidence and sufficient confidence."
REASON_WEAK = "Relationship has source evidence but lower confidence."
REASON_FORCED = "Relationship status was set by derivation rule."
REASON_LINK = "Asset-document support is an indirect derived link."
GRAPH_COLUMNS = {
    "Location": -1, "Equipment": 0, "Historian Signal": 1, "Process Parameter": 1,
    "Failure Mode": 2, "Safety Hazard": 2, "Maintenance Activity": 3, "Maintenance Event": 3,
    "Work Order": 3, "Spare Part": 4, "Permit Control": 4, "PPE Requirement": 4,
    "Audit Status": 5, "Compliance Gap": 5, "Contradiction": 5, "Inspection Date": 5,
    "Regulation": 6, "Person": 6, "Document Date": 6, "Document": 7,
}
OTHER_GRAPH_COLUMN = 8
GRID_X, GRID_Y = 260, 128
CORE_EXCLUDED_TYPES = [
    "Audit Status", "Document", "Document Date", "Inspection Date", "Location",
    "Maintenance Activity", "Maintenance Event", "Process Parameter",
]

# -- upload gate --------------------------------------------------------------
MIME_BY_EXTENSION = {
    ".pdf": ["", "application/octet-stream", "application/pdf"],
    ".docx": [
        "", "application/octet-stream",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip",
    ],
    ".xlsx": [
        "", "application/octet-stream",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip",
    ],
    ".txt": ["", "application/octet-stream", "text/plain"],
    ".csv": [
        "", "application/csv", "application/octet-stream", "application/vnd.ms-excel", "text/csv", "text/plain",
    ],
}
ZIP_PREFIX = {".docx": "word/", ".xlsx": "xl/"}
BINARY_SAMPLE = 8192

# -- model text folding -------------------------------------------------------
FOLD_FROM = "\u00a0\u202f\u2010\u2011\u2012\u2013\u2014\u2212\u2018\u2019\u201c\u201d"
FOLD_TO = "  ------''\"\""
ELLIPSIS = "\u2026"

# -- display labels -----------------------------------------------------------
ACRONYMS = "ai api csv docx et gpt hse hx llm oem oss pdf ppe rca sop txt v4 xlsx".split()
MINOR_WORDS = "and as at by for from in of on or the to with".split()
SPECIAL_WORDS = {"deepseek": "DeepSeek"}

# -- redaction ----------------------------------------------------------------
SENSITIVE_KEYS = [
    "api-key", "authorization", "cookie", "password", "proxy-authorization", "secret", "set-cookie", "token",
]
REDACTED = "[redacted]"

# -- messages -----------------------------------------------------------------
DEFAULT_CORRECTIVE_ACTION = "Investigate and close the cited compliance gap."
STALE_MESSAGE = "Uploaded documents changed after the last completed analysis."
GAP_CONFIDENCE = 0.9
ANSWER_CONFIDENCE_CAP = 0.94
RELATED_TYPES = ["Equipment", "Failure Mode", "Spare Part"]
