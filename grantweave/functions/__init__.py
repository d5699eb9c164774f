"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from grantweave.functions.columns import (  # noqa: F401
    comma_items,
    dotted,
    nonblank_items,
    present,
    py_strip,
)
from grantweave.functions.render import (  # noqa: F401
    STATEMENT_PATTERN,
    fits_group,
    fits_name,
    fits_privilege,
    fits_type,
    mask_function_name,
    parse_statement,
    parse_statements,
    render_statement,
    render_tag_statement,
    short_object_name,
)
from grantweave.functions.sizing import broadcast_if_literal  # noqa: F401
