"""Values the results depend on.

Fixed values: word lists, lookup tables, constants, patterns and output texts.
They are contract data, kept in one place and in natural order; every rule that
uses them lives elsewhere.
"""

# --- event vocabulary ---------------------------------------------------------

EVENT_TYPES = (
    "browser_activity", "app_install", "app_launch", "file_access",
    "file_transfer", "usb_connect", "network_connection", "dns_query",
    "cloud_upload", "login_event", "device_connect",
)
# device_connect has no indicator column: it only adds to the event counts.
INDICATOR_EVENT_TYPES = EVENT_TYPES[:10]
NETWORK_EVENT_TYPES = ("network_connection", "dns_query", "browser_activity", "cloud_upload")
FILE_EVENT_TYPES = ("file_access", "file_transfer", "cloud_upload")

RISK_CATEGORIES = ("Informational", "Low", "Medium", "High", "Critical")
FLAGGED_CATEGORIES = ("High", "Critical")

CASB_SOURCE = "shadow_it_synthetic"
CERT_SOURCE = "cert_insider_threat"
CASB_TENANT = "shadow_corp"
CERT_TENANT = "cert_insider_threat"

# --- domain and auth word lists ----------------------------------------------

UPLOAD_DOMAIN_HINTS = (
    "wikileaks", "pastebin", "mega.nz", "mega.co", "mediafire",
    "wetransfer", "4shared", "rapidshare", "dropbox", "drive.google",
    "anonfiles", "gofile", "transfernow",
)
EXFIL_DOMAIN_HINTS = UPLOAD_DOMAIN_HINTS + (
    "chatgpt", "gemini", "claudeai", "telegram", "whatsappweb", "discord",
)
DOWNLOAD_EXTENSIONS = (
    ".exe", ".zip", ".rar", ".7z", ".msi", ".dmg", ".torrent",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".pptx", ".iso",
)
LIVE_EXFIL_HINTS = (
    "wikileaks", "mega.nz", "mega.co", "wetransfer", "pastebin",
    "anonfiles", "gofile", "sendspace", "dropbox", "drive.google",
)
LIVE_REMOVABLE_HINTS = ("usb", "removable", "d:\\", "e:\\", "f:\\")
WEAK_AUTH_METHODS = ("personal_email_signup", "shared_credential", "none")
RISKY_NETWORK_ZONES = ("public_wifi", "unrecognized_foreign_ip", "mobile_hotspot")
LOGIN_KEYWORDS = ("logon", "logged", "log on", "session", "screen locked")
INTERNAL_MAIL_SUFFIX = "@dtaa.com"
REMOVABLE_CATEGORY = "Removable Media & Offline Transfer"

# --- feature sets -------------------------------------------------------------

CONTINUOUS_FEATURES = (
    "hour", "day_of_week", "domain_len", "bytes_sent_log",
    "bytes_received_log", "file_size_log",
)
DAILY_SUM_FEATURES = (
    "is_removable_media", "is_exfil_domain", "has_file", "weak_auth",
    "risky_network_zone", "is_shadow_it", "sanction_unsanctioned", "external_recipient",
)
DAILY_MAX_FEATURES = ("bytes_sent_log", "bytes_received_log", "file_size_log", "domain_len")
DAILY_MEAN_FEATURES = (
    "is_off_hours", "is_weekend", "device_managed", "has_admin_rights",
    "security_training_current",
)
SENTINEL = -1
Z_CLIP = 8.0
ZERO_VARIANCE = 1e-9
SHRINKAGE_K = 30.0

# --- CASB activity map --------------------------------------------------------

CASB_ACTIVITY_EVENT_TYPE = {
    "file_view": "file_access",
    "file_edit": "file_access",
    "file_download": "file_access",
    "print_export": "file_access",
    "report_generate": "file_access",
    "file_upload": "file_transfer",
    "external_share_link_created": "cloud_upload",
    "software_install": "app_install",
    "browser_extension_install": "app_install",
    "saas_signup": "app_install",
    "video_call": "app_launch",
    "screen_share": "app_launch",
    "calendar_event": "app_launch",
    "code_commit": "app_launch",
    "code_push": "app_launch",
    "pull_request": "app_launch",
    "ticket_update": "app_launch",
    "ticket_create": "app_launch",
    "crm_update": "app_launch",
    "expense_submit": "app_launch",
    "login": "login_event",
    "oauth_grant": "login_event",
    "api_token_issued": "login_event",
    "device_enrollment_bypass": "login_event",
    "ai_prompt_submission": "browser_activity",
    "chat_message": "browser_activity",
    "email_send": "network_connection",
    "email_receive": "network_connection",
    "vpn_connect_personal": "network_connection",
    "usb_transfer": "usb_connect",
}
CASB_DEFAULT_EVENT_TYPE = "app_launch"
CASB_RISK_TIER = {"Low": "low", "Medium": "medium", "High": "high", "Critical": "critical"}
CASB_HISTORY_DAYS = 90

# --- SIEM rule table: rule id, event type, category, signal --------------------

SIEM_RULES = (
    ("100011", "dns_query", "Unapproved Cloud Storage & File Sharing", "is_exfil_domain"),
    ("100012", "dns_query", "Unapproved Cloud Storage & File Sharing", "is_exfil_domain"),
    ("100021", "dns_query", "Unsanctioned AI Tools", "is_exfil_domain"),
    ("100022", "dns_query", "Unsanctioned AI Tools", "is_exfil_domain"),
    ("100031", "app_launch", "Unapproved Cloud Storage & File Sharing", "is_exfil_domain"),
    ("100033", "dns_query", "Unapproved Cloud Storage & File Sharing", "is_exfil_domain"),
    ("100041", "app_launch", "Unauthorized Software Installs", None),
    ("100042", "app_install", "Unauthorized Software Installs", None),
    ("100043", "app_launch", "Unauthorized Software Installs", None),
    ("100050", "file_transfer", "Removable Media & Offline Transfer", "is_removable_media"),
    ("100060", "file_access", None, None),
    ("100061", "file_access", None, None),
)
SIEM_SOURCE = "wazuh"

# --- technique tags -----------------------------------------------------------

CATEGORY_TECHNIQUE = {
    "Unsanctioned AI Tools": "T1567.002",
    "Unapproved Cloud Storage & File Sharing": "T1567.002",
    "Unsanctioned Messaging & Collaboration": "T1071.001",
    "Third-Party Integrations & OAuth Grants": "T1071.001",
    "Unauthorized Software Installs": "T1204",
    "Personal Devices (BYOD)": "T1071.001",
    "Departmental / Citizen IT": "T1204",
    "Removable Media & Offline Transfer": "T1052.001",
}
SIGNAL_TECHNIQUE = {
    "is_removable_media": "T1052.001",
    "external_recipient": "T1071.001",
    "is_exfil_domain": "T1567.002",
}
DEFAULT_TECHNIQUE = "T1052"

# --- remediation --------------------------------------------------------------

CATEGORY_SECTION = {
    "Unsanctioned AI Tools": "9.6",
    "Unapproved Cloud Storage & File Sharing": "9.4",
    "Unsanctioned Messaging & Collaboration": "9.5",
    "Third-Party Integrations & OAuth Grants": "9.3",
    "Unauthorized Software Installs": "9.10",
    "Personal Devices (BYOD)": "9.2",
    "Departmental / Citizen IT": "9.7",
    "Removable Media & Offline Transfer": "9.1",
}
SIGNAL_SECTION = {
    "is_removable_media": "9.1",
    "external_recipient": "9.5",
    "is_exfil_domain": "9.4",
}
SECTION_HEADER = r"(?m)^## (9\.\d+) (.+)$"
FIX_ENTRY = r"\*\*Fix (\d+) — (.+?)\.\*\*\s*\*\(([^)]+)\)\*"

# --- action tiers -------------------------------------------------------------

BASE_TIER = {"Informational": "R1", "Low": "R1", "Medium": "R2", "High": "R3", "Critical": "R6"}
TIER_LABEL = {
    "R1": "No action / log only",
    "R2": "Notify employee (educate)",
    "R3": "Flag for IT review",
    "R4": "Recommend sanctioned-alternative evaluation",
    "R5": "Recommend block/restrict",
    "R6": "Escalate to security (critical)",
}
TIER_ABOVE = {"R1": "R2", "R2": "R3", "R3": "R4", "R4": "R5", "R5": "R6", "R6": "R6"}
FLOOR_RAISED_TIERS = ("R1", "R2", "R3")
SELF_AUDIT_ANSWERS = ("confirmed", "denied")
REPEAT_THRESHOLD = 3
PEER_PREVALENCE_THRESHOLD = 0.40
DENIED_TEXT = (
    "self_audit_response='denied' on a legitimate account is treated as a "
    "stronger signal than the original anomaly -- forced to R6 regardless of base tier."
)
PREVALENCE_TEXT = (
    "redirected to R4 (widespread pattern suggests unmet business need, "
    "not individual risk, per spec worked example 3)."
)
BASE_TIER_TEXT = ("risk_category='", "' -> base tier ", " (", ").")
PREVALENCE_LEAD = ("peer_prevalence=", " >= ", " threshold -- ")
REPEAT_TEXT = ("repeat_count=", " >= ", " threshold -- escalated one step: ", " -> ", ".")
FLOOR_TEXT = ("is_known_bad_category=True (matched a Wazuh CDB list) -- raised floor from ",
              " to R5 regardless of statistical tier.")
TECHNIQUE_NOTE_TEXT = ("wazuh_reported=", ", pipeline_assigned=")
MODEL_FINDING_SIGNAL = "ml_pipeline_daily_risk"
MODEL_FINDING_TEXT = ("ML pipeline day-level risk assessment: ", " (", " events this day, driver event ", "). ", ".")
SHORT_HISTORY_TEXT = (" (baseline confidence ", "% -- limited history, treat with extra caution)")

# --- alert export -------------------------------------------------------------

ALERT_SEVERITY = {"Low": "low", "Medium": "medium", "High": "high", "Critical": "critical"}
SEVERITIES = ("low", "medium", "high", "critical")
FEATURE_EVIDENCE = {
    "is_exfil_domain": ("Known exfiltration-pattern domain",
                        "Destination domain matches a known personal-cloud/exfiltration pattern (deviation {val})."),
    "is_removable_media": ("Removable media activity",
                           "Event involved a removable storage device (deviation {val})."),
    "is_off_hours": ("Off-hours activity",
                     "Activity occurred outside this user's established working hours (deviation {val})."),
    "bytes_sent_log": ("Volume anomaly",
                       "Data transfer volume is a significant deviation from this user's baseline (deviation {val})."),
    "weak_auth": ("Weak authentication method",
                  "Access used a weak or non-standard authentication method (deviation {val})."),
    "risky_network_zone": ("Risky network context",
                           "Activity originated from a network zone flagged as higher-risk (deviation {val})."),
    "device_managed": ("Unmanaged device",
                       "Activity occurred on a device not enrolled in device management (deviation {val})."),
    "is_shadow_it": ("Unsanctioned application",
                     "Application is not in the approved inventory (deviation {val})."),
    "external_recipient": ("External recipient",
                           "Data was sent to a recipient outside the organization (deviation {val})."),
    "daily_event_count": ("Unusual daily activity volume",
                          "Total activity for this day is a significant deviation from baseline (deviation {val})."),
}
ALERT_CSV_COLUMNS = (
    "id", "userId", "userName", "department", "severity", "score",
    "app", "category", "status", "createdAt", "tier",
)
SIGNAL_LABEL = {
    "time_anomaly": "Time anomaly",
    "volume_anomaly": "Volume anomaly",
    "new_domain": "New domain",
    "peer_comparison": "Peer comparison",
}
NOT_SCORED_TEXT = "Not yet scored -- awaiting anomaly detection."
PAGE_SIZE = 5

# --- online detection ---------------------------------------------------------

MAD_TO_SIGMA = 1.4826
Z_ALERT = 3.0
MIN_PEER_COHORT = 5
MIN_LOGIN_SAMPLES = 5
MIN_VOLUME_DAYS = 5
BASELINE_WINDOW_DAYS = 7
DEFAULT_DEPARTMENT = "tenant-default"
NEW_DOMAIN_SCORE = {"package": 20, "engine": 35}
AI_FIRST_USE_SCORE = 15
SENSITIVE_SCORE_HIGH = 50
SENSITIVE_SCORE = 30
EXPLANATION = {
    "unknown_application": "Application is not in the catalogue and requires review; it was not automatically blocked.",
    "unapproved_app": "Application is marked unapproved by policy.",
    "ai_tool_first_use": "First observed use of a catalogued AI tool for this user.",
    "new_domain": "Destination has not appeared in this user's baseline window.",
    "time_anomaly": "Login time is outside the user's established pattern.",
    "volume_anomaly": "Transfer volume is outside the user's established daily range.",
    "peer_comparison": "Transfer volume is unusual relative to the department cohort.",
    "sensitive_upload": "Controlled DLP outcome indicates sensitive-data detectors fired.",
}
ORCHESTRATED_TIER = {"critical": "R6", "high": "R4", "medium": "R3", "low": "R2"}
ORCHESTRATED_ACTION = {
    "critical": "Escalate to security for human review. Do not take automated enforcement action.",
    "high": "Flag for analyst review.",
    "medium": "Review when convenient.",
    "low": "No action required; retained for context.",
}
NO_SIGNAL_TEXT = "No anomaly signals identified for this event. Review manually if warranted."
CANONICAL_KINDS = (
    "network_access", "installed_application", "file_upload", "dlp_outcome", "file_integrity",
)
CANONICAL_SOURCES = ("simulator", "wazuh", "opensearch_mock")
TENANT_PATTERN = r"^[a-z0-9][a-z0-9-]{2,63}$"
PROHIBITED_KEYS = (
    "content", "clipboard", "password", "secret", "token",
    "authorization", "cookie", "raw_url", "query", "file_contents",
)
PROHIBITED_KEYS_TOP_LEVEL = (
    "content", "clipboard", "password", "secret", "token", "raw_url", "file_contents",
)
COLLECTOR_KINDS = {
    "browser": "network_access", "installed_app": "installed_application",
    "upload": "file_upload", "dlp": "dlp_outcome",
}
LIVE_INDICATOR = {
    "installed_application": "et_app_install",
    "file_upload": "et_file_transfer",
    "dlp_outcome": "et_file_transfer",
}
SECURITY_KIND = {
    "installed_application": "activity",
    "file_upload": "transfer",
    "dlp_outcome": "transfer",
    "file_integrity": "activity",
}
HEARTBEAT_STALE_SECONDS = 150

# --- standing actions per trend category --------------------------------------

STANDING_ACTION = {
    "Shadow AI": "Evaluate a sanctioned alternative",
    "Personal cloud": "Escalate for security review",
    "Unauthorized SaaS": "Notify + self-audit prompt",
}
DEFAULT_STANDING_ACTION = "Route to manual triage"

# --- sensitive text -----------------------------------------------------------

TEXT_DETECTORS = {
    "api_key": r"(?i)\bapi[_-]?key\s*[:=]\s*['\"]?[a-z0-9_-]{12,}",
    "password": r"(?i)\bpassword\s*[:=]\s*['\"]?\S{8,}",
    "jwt": r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "ssn": r"\b(?!000|666|9\d\d)\d{3}-\d{2}-\d{4}\b",
    "connection_string": r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s]+",
}
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CARD_PATTERN = r"\b(?:\d[ -]?){13,19}\b"
HIGHLY_CONFIDENTIAL = ("aws_key", "ssn", "credit_card", "password")
EMAIL_LIST_MINIMUM = 3
REDACT_HEADER = r"(?i)(authorization|x-api-key|token|password)=?[^\s,;]+"
REDACT_CLOUD_KEY = r"AKIA[0-9A-Z]{16}"

# --- evaluation and models ----------------------------------------------------

SWEEP_CUTOFFS = (0.10, 0.12, 0.14, 0.15, 0.16, 0.18, 0.20, 0.25)
SELECTED_CUTOFF = 0.15
PERCENTILE_CUTOFFS = (70.0, 90.0, 97.0, 99.0)
PROBABILITY_CUTOFFS = (0.02, 0.10, 0.50, 0.90)
SCORER_CUTOFFS = (0.02, 0.10, 0.9926, 0.9984)
CLASSIFIER_WEIGHT = 0.85
HEURISTIC_EVENT_AUC = 0.6159
TREE_SEARCH_SPACE = {
    "max_depth": (3, 5, 7, 10, 12, 15, 20, None),
    "min_samples_split": (2, 5, 10, 20, 50, 100),
    "min_samples_leaf": (1, 2, 5, 10, 20, 50),
    "criterion": ("gini", "entropy"),
}
FEATURE_PENALTY = 0.03

# What a log lacks: kind, flag of ``cert_logs.column_flags``, and the note.
LOG_NOTES = (
    ("file", "has_removable_flags", "no removable media columns: rows count as file access"),
    ("http", "has_activity", "no activity column: the URL decides"),
    ("http", "has_size", "no size column: content length instead"),
)
