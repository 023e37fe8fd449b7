"""Scalar Column builders, all Catalyst expressions."""

from fleetcat.functions.code import (  # noqa: F401
    classify_parameter, classify_source, computed_excerpt, hana_source_info, is_binary_payload, is_hardcoded_connection, parameter_excerpt, source_excerpt,
)
from fleetcat.functions.names import (  # noqa: F401
    clean_field_name, is_measure_field, is_system_table, is_technical, is_technical_card, safe_id,
    visual_label, well_label, well_of,
)
from fleetcat.functions.text import (  # noqa: F401
    area_ratio, error_code, error_hash, escape_html, field_reference, fit_label, format_geometry,
    is_control, layer_of, model_fingerprint, redact_secrets, redact_sensitive,
)
