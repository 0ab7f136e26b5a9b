from tyscope.functions.columns import (
    BASE_TYPES,
    base_type,
    basename,
    creation_year,
    format_created_at,
    percent_share,
    repo_root,
    split_full_name,
    truncate,
)

__all__ = [
    "BASE_TYPES", "base_type", "basename", "creation_year", "format_created_at",
    "percent_share", "repo_root", "split_full_name", "truncate",
]
