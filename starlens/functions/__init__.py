"""Column -> Column helpers.  All are built-in Spark expressions (whole-stage codegen, no Python UDF)."""

from starlens.functions.text import (  # noqa: F401
    WS_CLASS,
    char_length,
    clean_text,
    merge_text,
    strip_html,
    strip_ws,
    tokens,
    truncate_text,
    word_count,
)
from starlens.functions.features import (  # noqa: F401
    epoch_ms,
    group_label,
    image_count,
    length_bucket2,
    length_bucket5,
    misleading,
    month_end,
    rating_diff,
    time_weight,
    verified_label,
)
