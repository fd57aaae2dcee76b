"""Closed label sets, word lists and tuning numbers.

Everything here is a plain statement of a value that results depend on.
"""

from __future__ import annotations

# Closed label sets ---------------------------------------------------------
SPEAKERS = ["AGENT", "CUSTOMER", "UNKNOWN"]
LANGUAGES = ["hi", "en", "hi-en", "hi-roman", "ta", "te", "other"]
INTENTS = [
    "policy_details", "premium_payment", "claim_process", "claim_rejection", "renewal",
    "nominee_update", "document_request", "cancellation", "maturity_benefit",
    "health_coverage", "exclusions", "agent_complaint", "grievance", "other_insurance",
    "other",
]
CALL_STATUSES = [
    "pending", "stt_running", "stt_done", "diarization_running", "diarization_done",
    "extraction_running", "extraction_done", "analysis_running", "analysis_done",
    "embedding_done", "clustered", "failed",
]
QUESTION_TYPES = ["question", "complaint", "doubt", "intent"]
FEEDBACK_ACTIONS = [
    "merge_clusters", "split_cluster", "relabel_intent", "regenerate_faq", "reassign_question",
]
CLUSTER_RELATIONS = ["leads_to", "related_to", "subset_of", "opposes", "caused_by", "co_occurs"]
ENTITY_RELATIONS = [
    "received_call", "handled_by", "has_disposition", "has_sentiment", "about_product",
    "interested_in", "in_campaign", "similar_to",
]
EDGE_RELATIONS = CLUSTER_RELATIONS + ENTITY_RELATIONS
DISPOSITIONS = [
    "resolved", "info_provided", "callback_requested", "follow_up_payment", "complaint",
    "escalation", "not_interested", "not_eligible", "service_request", "wrong_number",
    "dnd", "no_response", "other",
]
SENTIMENTS = ["positive", "neutral", "negative"]
DIRECTIONS = ["inbound", "outbound", "unknown"]
NODE_TYPES = ["lead", "call", "agent", "campaign", "product", "disposition", "sentiment"]

# Most significant disposition first ------------------------------------------
DISPOSITION_SIGNIFICANCE = [
    "escalation", "complaint", "follow_up_payment", "callback_requested", "service_request",
    "not_eligible", "not_interested", "dnd", "wrong_number", "resolved", "info_provided",
    "no_response", "other",
]

# Call summary output: column name -> lead field, in output order ---------------
CALL_SUMMARY_COLUMNS = [
    "PHONE_NUMBER", "CALL_DISPOSITION", "CALL_SENTIMENT", "CALL_ESCALATION", "CALL_N_CALLS",
    "CALL_LAST_DATE", "CALL_LEAD_NAME", "CALL_LEAD_EMAIL", "CALL_LEAD_OCCUPATION",
    "CALL_LEAD_INCOME_BAND", "CALL_LEAD_PRODUCT_INTEREST", "CALL_LEAD_PINCODE",
    "CALL_SOURCE_CALL_IDS", "CALL_CONFIDENCE",
]
SUMMARY_LEAD_FIELDS = {
    "CALL_LEAD_NAME": "full_name",
    "CALL_LEAD_EMAIL": "email",
    "CALL_LEAD_OCCUPATION": "occupation",
    "CALL_LEAD_INCOME_BAND": "income_band",
    "CALL_LEAD_PRODUCT_INTEREST": "product_interest",
    "CALL_LEAD_PINCODE": "pincode",
}
LEAD_FIELDS = [
    "full_name", "phone", "email", "age", "gender", "occupation", "education", "income_band",
    "pincode", "product_interest", "policy_no", "callback_time",
]

# Spellings that mean "no value" ----------------------------------------------
NULL_TOKENS = ["", "NA", "N/A", "NULL", "NONE", "#N/A", "NAN", "-", "--"]

# Call-detail record headers: logical field -> CSV header -------------------------
CDR_COLUMNS = {
    "crux_call_id": "crux_call_id",
    "caller_phone": "caller_number",
    "agent_id": "agent_id",
    "campaign": "campaign",
    "started_at": "start_time",
    "direction": "direction",
}
INBOUND_TOKENS = ["in", "inbound", "mt"]
OUTBOUND_TOKENS = ["out", "outbound", "mo"]

# Free-text disposition (lower case) -> closed disposition ---------------------------
LMS_CROSSWALK = {
    "ringing": "no_response",
    "call not connected/beep tone": "no_response",
    "ivr tone": "no_response",
    "short hang up": "no_response",
    "call back - ringing": "no_response",
    "call back later": "callback_requested",
    "buy later": "callback_requested",
    "just browsing": "not_interested",
    "ni - due to service": "not_interested",
    "ni - due to product": "not_interested",
    "ni - due to price": "not_interested",
    "ni - need offline policy": "not_interested",
    "ne - ne due to income": "not_eligible",
    "ne - ne due to documents not avaible(education)": "not_eligible",
    "ne - ne due to documents not avaible": "not_eligible",
    "ne - ne due to medical history": "not_eligible",
    "nw - incorrect request": "wrong_number",
    "incorrect request": "wrong_number",
    "nw - never left name and number": "wrong_number",
    "never left name and number": "wrong_number",
    "nw - dnc": "dnd",
    "nw - service request": "service_request",
    "nw - duplicate sale closed(already assisted)": "service_request",
    "follow up for payment": "follow_up_payment",
    "meeting scheduled": "other",
    "looking for other product(health or loan)": "not_interested",
    "loan requirement": "not_interested",
}

# Speaker labels --------------------------------------------------------------
AGENT_ALIASES = ["AGENT", "A", "AGT"]
CUSTOMER_ALIASES = ["CUSTOMER", "C", "CUST", "CLIENT"]
GREETING_TOKENS = [
    "namaste", "namaskar", "good morning", "good afternoon", "good evening", "hello", "hi",
    "thank you for calling", "bajaj allianz", "bajaj", "hdfc life", "icici prudential", "lic",
    "sbi life", "max life", "tata aia", "kotak life", "aviva", "policy bazaar",
]
INTERROGATIVE_TOKENS = [
    "kya", "kyu", "kyun", "kyon", "kaise", "kaisa", "kaisi", "kab", "kahan", "kahaan",
    "kahaa", "kitna", "kitni", "how", "what", "why", "when", "where", "which", "?",
    "enna", "eppadi", "eppo", "yenna", "evaru", "ela", "endhuku",
]

# Language word lists ---------------------------------------------------------
ROMAN_HINDI_TOKENS = [
    "hai", "haiye", "kya", "kyu", "kyun", "kaise", "kab", "kahaan", "kaha", "mera", "meri",
    "aap", "aapka", "aapki", "main", "mujhe", "humara", "hum", "nahi", "nahin", "haan", "ji",
    "matlab", "kitna", "kitni", "kaisa", "kaisi", "wala", "wali", "thik", "theek", "kuch",
    "chahiye", "milega", "milegi", "kar", "karna", "kara", "kari", "ho", "hua", "hui", "rha",
    "raha", "rahi", "policy", "premium", "claim", "nominee", "renewal",
]
HINGLISH_MARKERS = [
    "kya", "hai", "hain", "ka", "ki", "ke", "ko", "mein", "mera", "meri", "mere", "aap",
    "aapka", "aapki", "hum", "humara", "hamari", "kab", "kaise", "kyun", "kyon", "nahi",
    "nahin", "haan", "ji", "kar", "karna", "karenge", "kiya", "kyu", "ho", "hoga", "hogi",
]
STT_LANGUAGE_HEADS = {"hi": "hi", "en": "en", "ta": "ta", "te": "te"}

# Personal-data patterns (first alternative listed first) -------------------------
PII_PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b|\b\d{5}-\d{4}\b",
    "PHONE": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b\d{10}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "AADHAR": r"\b\d{4}-\d{4}-\d{4}\b|\b\d{12}\b",
    "PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}
PII_SEVERITY = {"SSN": "high", "AADHAR": "high", "PAN": "high", "PHONE": "medium", "EMAIL": "low"}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# Upload gate -----------------------------------------------------------------
AUDIO_EXTENSIONS = [".wav", ".mp3", ".m4a", ".ogg", ".flac", ".webm", ".mp4"]
TRANSCRIPT_EXTENSIONS = [".json"]
UPLOAD_MAX_BYTES = 200 * 1024 * 1024
DEFAULT_STT_PROVIDER = "sarvam"

# Graph notes: node type -> folder -------------------------------------------------
NOTE_FOLDERS = {
    "lead": "leads", "call": "calls", "agent": "agents", "campaign": "campaigns",
    "product": "products", "disposition": "dispositions", "sentiment": "sentiments",
}

# Tuning numbers --------------------------------------------------------------
ASSIGN_THRESHOLD = 0.78
MERGE_THRESHOLD = 0.90
EDGE_TOP_K = 8
EDGE_MIN_SIMILARITY = 0.55
EDGE_MAX_PER_SOURCE = 6
EDGE_MIN_WEIGHT = 0.5
DENSITY_MIN_CLUSTER_SIZE = 8
DENSITY_MIN_SAMPLES = 4
CHUNK_BUDGET = 12_000
ANALYSIS_BUDGET = 14_000
WAVEFORM_BARS = 72
FAQ_EXAMPLES = 12
CACHE_TTL_DAYS = 7
IDEMPOTENCY_HOURS = 24
IDEMPOTENCY_MAX_KEY = 128
SEGMENT_DEFAULT_CONFIDENCE = 0.8
DIARIZED_CONFIDENCE = 0.85
STAGE_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
STAGE_SLO_SECONDS = {"embed": 4.0, "cluster": 6.0}
