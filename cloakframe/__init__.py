"""Personal data in tables and streams: find, redact, mask, restore, monitor."""

from .functions.validators import (
    is_canonical_uuid,
    is_valid_bsn,
    is_valid_iban,
    is_valid_postal_code,
    register_sql_functions,
)
from .operators.columns import ColumnRule, mask_table, mask_tables
from .operators.detect import auto_detect, find_emails, find_phones, find_pii, register_detector, with_findings
from .operators.redact import redact_corpus, redact_fixed, redact_reversible
from .operators.rules import TextRule, apply_rules
from .plans.restore_job import restore_texts
from .plans.text_job import preview_texts, redact_texts

__all__ = [
    "ColumnRule",
    "TextRule",
    "apply_rules",
    "auto_detect",
    "find_emails",
    "find_phones",
    "find_pii",
    "is_canonical_uuid",
    "is_valid_bsn",
    "is_valid_iban",
    "is_valid_postal_code",
    "mask_table",
    "mask_tables",
    "preview_texts",
    "redact_corpus",
    "redact_fixed",
    "redact_reversible",
    "redact_texts",
    "register_detector",
    "register_sql_functions",
    "restore_texts",
    "with_findings",
]
