"""Ten hand-checked cases.  Steps are (event type, hours after receipt, actor, kind)."""

from datetime import datetime, timedelta

BASE = datetime(2026, 1, 5, 9)
ADMIN, TEAM, SCHED = "admin_staff", "clinical_team", "scheduling_staff"

TYPES = {
    "submitted": "referral_submitted",
    "received": "referral_received",
    "check": "completeness_check_completed",
    "request": "missing_information_requested",
    "info": "missing_information_received",
    "categorised": "referral_categorised",
    "recategorised": "referral_recategorised",
    "assigned": "clinical_team_assigned",
    "reassigned": "clinical_team_reassigned",
    "started": "appointment_scheduling_started",
    "failed": "appointment_scheduling_failed",
    "booked": "appointment_booked",
    "notified": "patient_notified",
    "no_response": "patient_no_response",
    "completed": "referral_completed",
    "cancelled": "referral_cancelled",
    "rejected": "referral_rejected",
}


def tail(s, skip=0):
    steps = [
        ("categorised", s, "ADMIN-001"),
        ("assigned", s + 1, "ADMIN-001"),
        ("started", s + 2, "SCHED-001"),
        ("booked", s + 4, "SCHED-001"),
        ("notified", s + 4.1, None),
        ("completed", s + 5, "ADMIN-001"),
    ]
    return steps[skip:]


CASES = [
    ("STRAIGHT0001", "completed", [("check", 2, "ADMIN-001"), *tail(3)]),
    (
        "MISSING0001",
        "completed",
        [
            ("check", 2, "ADMIN-002"),
            ("request", 2.5, "ADMIN-002"),
            ("info", 26, None),
            ("check", 27, "ADMIN-002"),
            *tail(28),
        ],
    ),
    (
        "MISSING0002",
        "completed",
        [
            ("check", 2, "ADMIN-003"),
            ("request", 3, "ADMIN-003"),
            ("info", 27, None),
            ("check", 28, "ADMIN-003"),
            ("request", 29, "ADMIN-003"),
            ("info", 53, None),
            ("check", 54, "ADMIN-003"),
            *tail(55),
        ],
    ),
    (
        "REROUTE0001",
        "completed",
        [
            ("check", 2, "ADMIN-004"),
            ("categorised", 3, "ADMIN-004"),
            ("recategorised", 5, "ADMIN-005"),
            ("assigned", 6, "ADMIN-005"),
            ("reassigned", 10, "TEAM-MSK"),
            *tail(11, 2),
        ],
    ),
    (
        "SCHEDULE0001",
        "completed",
        [
            ("check", 2, "ADMIN-006"),
            *tail(3)[:2],
            ("started", 5, "SCHED-002"),
            ("failed", 6, "SCHED-002"),
            ("started", 30, "SCHED-002"),
            ("failed", 31, "SCHED-002"),
            ("started", 55, "SCHED-002"),
            *tail(55, 3),
        ],
    ),
    (
        "CANCEL0001",
        "cancelled",
        [("check", 2, "ADMIN-007"), ("request", 3, "ADMIN-007"), ("cancelled", 51, "ADMIN-007")],
    ),
    ("REJECT0001", "rejected", [("check", 2, "ADMIN-008"), ("rejected", 3, "ADMIN-008")]),
    (
        "STUCK0001",
        "awaiting_information",
        [("check", 2, "ADMIN-009"), ("request", 3, "ADMIN-009"), ("no_response", 171, "ADMIN-009")],
    ),
    ("DUPLICATE0001", "completed", [("received", 0, None), ("check", 2, "ADMIN-010"), *tail(3)]),
    (
        "DELAYED0001",
        "completed",
        [("check", 2, "ADMIN-011"), ("categorised", 4, "ADMIN-011"), *tail(11, 1)],
    ),
]

EVENT_SCHEMA = (
    "event_id string, case_id string, external_event_id string, event_type string, "
    "event_at timestamp, ingested_at timestamp, actor_type string, actor_id string, "
    "source_system string, channel string, manual boolean, reason_code string, "
    "metadata string, team_id string, schema_version int"
)
CASE_SCHEMA = (
    "case_id string, external_source_id string, referral_source string, service_line string, "
    "status string, received_at timestamp, closed_at timestamp, schema_version int, "
    "created_at timestamp, updated_at timestamp"
)


def rows():
    events, cases = [], []
    for k, (code, status, steps) in enumerate(CASES):
        start = BASE + timedelta(days=k)
        full = [("submitted", -1, None), ("received", 0, None), *steps]
        last = None
        for i, (step, hour, actor) in enumerate(full):
            at = start + timedelta(hours=hour)
            delay, external = 0.02, f"SYNTH:{code}:{i + 1:03d}"
            if code == "DUPLICATE0001" and i == 2:
                delay, external = 0.5, f"SYNTH:{code}:002"
            if code == "DELAYED0001" and step == "check":
                delay = 8.0
            kind = "system"
            if step in ("submitted", "info"):
                kind = "referrer"
            elif actor:
                kind = {"A": ADMIN, "S": SCHED, "T": TEAM}[actor[0]]
            events.append(
                (
                    f"{k:02d}{i:02d}",
                    f"c{k}",
                    external,
                    TYPES[step],
                    at,
                    at + timedelta(hours=delay),
                    kind,
                    actor,
                    "synthetic_generator",
                    "portal",
                    actor is not None,
                    None,
                    "{}",
                    "TEAM-1" if step in ("assigned", "reassigned") else None,
                    1,
                )
            )
            last = at
        ended = status in ("completed", "cancelled", "rejected")
        cases.append(
            (
                f"c{k}",
                f"CASE-{code}",
                "gp_practice",
                "dermatology" if code == "REROUTE0001" else "musculoskeletal",
                status,
                start,
                last if ended else None,
                1,
                start,
                last,
            )
        )
    return events, cases


def frames(spark):
    events, cases = rows()
    return spark.createDataFrame(events, EVENT_SCHEMA), spark.createDataFrame(cases, CASE_SCHEMA)
