"""Fixed vocabularies of the default administrative-case preset.

These values are data, not behaviour: every operator takes its vocabulary as a
parameter (see :mod:`traceloom.spec`), and the tuples below are the defaults.
"""

# --- fixed values: event types and the activity label of each ---------------
ACTIVITY_LABELS = {
    "referral_submitted": "Referral submitted",
    "referral_received": "Referral received",
    "completeness_check_completed": "Completeness checked",
    "missing_information_requested": "Missing information requested",
    "missing_information_received": "Missing information received",
    "referral_categorised": "Referral categorised",
    "referral_recategorised": "Referral recategorised",
    "clinical_team_assigned": "Clinical team assigned",
    "clinical_team_reassigned": "Clinical team reassigned",
    "appointment_scheduling_started": "Scheduling started",
    "appointment_scheduling_failed": "Scheduling failed",
    "appointment_booked": "Appointment booked",
    "patient_notified": "Patient notified",
    "patient_no_response": "Patient no response",
    "referral_completed": "Referral completed",
    "referral_cancelled": "Referral cancelled",
    "referral_rejected": "Referral rejected",
    "referral_closed_other": "Referral closed other",
}
EVENT_TYPES = tuple(ACTIVITY_LABELS)

TERMINAL_EVENTS = (
    "referral_completed",
    "referral_cancelled",
    "referral_rejected",
    "referral_closed_other",
)
TERMINAL_ACTIVITIES = tuple(ACTIVITY_LABELS[e] for e in TERMINAL_EVENTS)

# Events that move a case forward.
PROGRESS_EVENTS = (
    "referral_received",
    "completeness_check_completed",
    "missing_information_requested",
    "missing_information_received",
    "referral_categorised",
    "referral_recategorised",
    "clinical_team_assigned",
    "clinical_team_reassigned",
    "appointment_scheduling_started",
    "appointment_booked",
    "patient_notified",
    "referral_completed",
    "referral_cancelled",
    "referral_rejected",
    "referral_closed_other",
)

# --- fixed values: case vocabulary ------------------------------------------
OPEN_STATUSES = (
    "received",
    "awaiting_information",
    "ready_for_categorisation",
    "categorised",
    "assigned",
    "scheduling",
    "appointment_booked",
)
TERMINAL_STATUSES = ("completed", "cancelled", "rejected", "closed_other")
STATUSES = OPEN_STATUSES + TERMINAL_STATUSES
REFERRAL_SOURCES = (
    "gp_practice",
    "community_clinic",
    "healthcare_professional",
    "internal_transfer",
)
SERVICE_LINES = (
    "cardiology",
    "dermatology",
    "musculoskeletal",
    "neurology",
    "respiratory",
)
SOURCE_SYSTEMS = (
    "referral_portal",
    "secure_email",
    "admin_system",
    "scheduling_system",
    "manual_entry",
    "synthetic_generator",
)
CHANNELS = (
    "portal",
    "secure_email",
    "phone",
    "sms",
    "letter",
    "internal_system",
    "not_applicable",
)
ACTOR_TYPES = (
    "referrer",
    "admin_staff",
    "clinical_team",
    "scheduling_staff",
    "patient",
    "system",
)
INTERNAL_ACTORS = ("admin_staff", "clinical_team", "scheduling_staff")

# --- fixed values: reason codes allowed per event type ----------------------
REASONS_BY_EVENT = {
    "missing_information_requested": (
        "missing_administrative_details",
        "invalid_administrative_details",
    ),
    "referral_recategorised": ("incorrect_category",),
    "clinical_team_reassigned": ("routing_correction", "capacity_rebalance"),
    "appointment_scheduling_failed": (
        "no_appointment_slot",
        "scheduling_system_error",
        "patient_unavailable",
    ),
    "patient_no_response": ("patient_unreachable",),
    "referral_cancelled": (
        "referrer_withdrew",
        "patient_cancelled",
        "patient_unreachable",
        "other_operational",
    ),
    "referral_rejected": (
        "duplicate_referral",
        "out_of_scope_service",
        "invalid_referral_source",
    ),
    "referral_closed_other": ("other_operational",),
}
REASON_CODES = (
    "missing_administrative_details",
    "invalid_administrative_details",
    "incorrect_category",
    "routing_correction",
    "capacity_rebalance",
    "no_appointment_slot",
    "scheduling_system_error",
    "patient_unavailable",
    "patient_unreachable",
    "referrer_withdrew",
    "patient_cancelled",
    "duplicate_referral",
    "out_of_scope_service",
    "invalid_referral_source",
    "other_operational",
)

# --- fixed values: privacy boundary -----------------------------------------
FORBIDDEN_KEYS = (
    "address",
    "clinical_notes",
    "clinical_narrative",
    "diagnosis",
    "email",
    "medical_history",
    "nhs_number",
    "patient_name",
    "patient_risk_score",
    "phone_number",
    "treatment",
)
FORBIDDEN_TERMS = (
    "diagnose",
    "diagnosis",
    "clinical urgency",
    "treatment decision",
    "patient prognosis",
    "clinical prioritisation",
)
SENSITIVE_PATTERNS = {
    "phone": r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b",
    "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "identifier": r"(?i)\b(?:nhs|patient)\s*(?:number|name|id)\s*[:=]",
}

# --- fixed values: identifier patterns --------------------------------------
EXTERNAL_EVENT_PATTERN = r"^[A-Z0-9][A-Z0-9._:-]{5,127}$"
ACTOR_PATTERN = r"^[A-Z][A-Z0-9_-]{2,63}$"

# --- fixed values: the two reference processes ------------------------------
STRICT_SEQUENCE = (
    "Referral submitted",
    "Referral received",
    "Completeness checked",
    "Referral categorised",
    "Clinical team assigned",
    "Scheduling started",
    "Appointment booked",
    "Patient notified",
    "Referral completed",
)
# (from state, to state, label); declaration order breaks ties in replay.
GOVERNED_STEPS = (
    ("p0", "p1", "Referral submitted"),
    ("p1", "p2", "Referral received"),
    ("p2", "p3", "Completeness checked"),
    ("p3", "p4", "Missing information requested"),
    ("p4", "p2", "Missing information received"),
    ("p4", "p4", "Patient no response"),
    ("p3", "p5", "Referral categorised"),
    ("p5", "p5", "Referral recategorised"),
    ("p5", "p6", "Clinical team assigned"),
    ("p6", "p6", "Clinical team reassigned"),
    ("p6", "p7", "Scheduling started"),
    ("p7", "p6", "Scheduling failed"),
    ("p7", "p7", "Patient no response"),
    ("p7", "p8", "Appointment booked"),
    ("p8", "p9", "Patient notified"),
    ("p9", "end", "Referral completed"),
)
GOVERNED_REJECTED_FROM = ("p2", "p3", "p4")
GOVERNED_CANCELLED_FROM = ("p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9")
GOVERNED_CLOSED_FROM = ("p4", "p6", "p7", "p8", "p9")

# --- fixed values: intake contract ------------------------------------------
FIELD_IDS = (
    "referral_form",
    "supporting_document",
    "source_acknowledgement",
    "routing_contact",
)
# state: (recommend, abstain, confirm, retry expected, suppress warning, resolved)
FIELD_STATES = {
    "present": (False, False, False, False, True, True),
    "absent": (True, False, True, False, False, False),
    "unknown": (False, True, False, True, False, False),
    "not_applicable": (False, False, False, False, True, True),
    "pending_source_update": (False, False, True, True, False, False),
    "unsupported": (False, True, False, False, False, False),
    "stale": (False, True, False, True, False, False),
    "conflicting": (False, True, False, False, False, False),
    "verification_required": (True, False, False, False, False, False),
}
CONTRACT_SOURCES = ("referral_portal", "secure_email", "manual_entry")
