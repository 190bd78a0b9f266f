"""Explicit schemas. ``seq`` is the input position, the tie-breaker of every pass; amounts are cents."""

PAYMENTS = "order_id string, payment_id string, amount long, currency string, status string, created_at date, seq long"
SETTLEMENTS = (
    "settlement_id string, payment_id string, gross long, fee long, tax long, net long, settled_at date, utr string, currency string, seq long"
)
CREDITS = "bank_credit_id string, utr string, amount long, credited_at date, currency string, seq long"
LABELS = (
    "bank_credit_id string, settlement_id string, settlement_ids array<string>, decoy_settlement_id string, label string, exception_type string,"
    " class string, level string, seq long"
)
MATCHES = "bank_credit_id string, settlement_id string, components array<string>, confidence double, matched_by string, reasoning string"
EXCEPTIONS = "record_id string, source string, reason string, exception_type string, precedence int, seq long"
CORRECTIONS = (
    "record_id string, source string, decision string, corrected_match_id string, components array<string>, score double, ts timestamp, seq long"
)
