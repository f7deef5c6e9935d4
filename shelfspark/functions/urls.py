"""URL functions: reference resolution and the product-URL predicate.

Arguments are SQL expressions (mostly column names), results are Columns; the `*_sql` forms return SQL
text for use inside higher-order functions.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import URL_ALLOW_CONTAINS, URL_ALLOW_SUFFIX, URL_DENY

# Schemes whose references resolve against a base (fixed values of the URL standard library).
_HIERARCHICAL = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# A reference that is its own result on any base: absolute, lower-case scheme, no empty query or fragment.
_ABSOLUTE = r"^https?://[^/?#\s]+[^?#\s]*(\?[^#\s]+)?(#\S+)?$"


def split_url_sql(url: str) -> str:
    """struct(scheme, netloc, path, query, fragment); missing parts are empty, netloc keeps its '//'."""
    scheme = r"[A-Za-z][A-Za-z0-9+.\-]*:"
    return f"""named_struct(
        'scheme', lower(regexp_extract({url}, r'^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)),
        'netloc', regexp_extract({url}, r'^(?:{scheme})?(//[^/?#]*)', 1),
        'path', regexp_extract({url}, r'^(?:{scheme})?(?://[^/?#]*)?([^?#]*)', 1),
        'query', regexp_extract({url}, r'^[^?#]*(\\?[^#]+)', 1),
        'fragment', regexp_extract({url}, r'(?s)^[^#]*(#.+)', 1))"""


def split_url(url: str) -> Column:
    return F.expr(split_url_sql(url))


def _remove_dots_sql(path: str) -> str:
    kept = f"""aggregate(split({path}, '/'), cast(array() as array<string>), (kept, s) -> case
        when s = '..' then slice(kept, 1, greatest(size(kept) - 1, 0)) when s = '.' then kept else concat(kept, array(s)) end)"""
    return f"""case when rlike({path}, r'(^|/)\\.{{1,2}}(/|$)') then concat(array_join({kept}, '/'),
        case when rlike({path}, r'(^|/)\\.{{1,2}}$') and size({kept}) > 0 then '/' else '' end) else {path} end"""


def resolve_all_sql(base: str, base_url: str, refs: str) -> str:
    """Absolute form of every reference in an array.

    `base` is `split_url(base_url)`; compute it once per page. Absolute references, the most common
    kind, cost one regular expression; the others are taken apart.
    """
    return f"""transform({refs}, x -> case when rlike(x, r'{_ABSOLUTE}') then x
        else {_join_all_sql(base, base_url, 'array(x)')}[0] end)"""


def _join_all_sql(base: str, base_url: str, refs: str) -> str:
    """The nested transforms keep each intermediate value in a lambda variable, so nothing is computed twice."""
    clean = r"regexp_replace(regexp_replace(ref, r'^[\x00-\x20]+', ''), r'[\t\r\n]', '')"
    split = f"transform({refs}, ref -> named_struct('ref', ref, 'u', {split_url_sql(clean)}))"
    # Inner empty segments vanish when a relative path is joined, but not in a rooted one.
    joined = f"""transform({split}, r -> named_struct('ref', r.ref, 'u', r.u, 'path',
        case when startswith(r.u.path, '/') then r.u.path
             else regexp_replace(concat(regexp_replace({base}.path, r'[^/]*$', ''), r.u.path), r'/{{2,}}', '/') end))"""
    schemes = ", ".join(f"'{s}'" for s in _HIERARCHICAL)
    rooted = f"""case when {base}.netloc <> '' then regexp_replace({_remove_dots_sql('r.path')}, r'^(?!/)', '/')
        else regexp_replace({_remove_dots_sql('r.path')}, r'^$', '/') end"""
    scheme = f"case when {base}.scheme = '' then '' else concat({base}.scheme, ':') end"
    return f"""transform({joined}, r -> case
        when {base_url} = '' then r.ref
        when r.ref = '' then {base_url}
        when (r.u.scheme <> '' and r.u.scheme <> {base}.scheme) or {base}.scheme not in ({schemes}) then r.ref
        when length(r.u.netloc) > 2 then concat({scheme}, r.u.netloc, r.u.path, r.u.query, r.u.fragment)
        when r.u.path = '' then concat({scheme}, {base}.netloc, {base}.path,
            case when r.u.query <> '' then r.u.query else {base}.query end, r.u.fragment)
        else concat({scheme}, {base}.netloc, {rooted}, r.u.query, r.u.fragment) end)"""


def resolve_url_sql(base_url: str, ref: str) -> str:
    bound = f"array({split_url_sql(base_url)})"
    return f"case when {ref} is not null then transform({bound}, b -> {resolve_all_sql('b', base_url, f'array({ref})')}[0])[0] end"


def resolve_url(base_url: str, ref: str) -> Column:
    """Absolute form of `ref` as found on the page `base_url`; null stays null."""
    return F.expr(resolve_url_sql(base_url, ref))


def is_product_url_sql(url: str, deny=URL_DENY, allow_contains=URL_ALLOW_CONTAINS, allow_suffix=URL_ALLOW_SUFFIX) -> str:
    denied = " or ".join(f"contains({url}, {quoted(part)})" for part in deny) or "false"
    return f"(not ({denied}) and (contains({url}, {quoted(allow_contains)}) or endswith({url}, {quoted(allow_suffix)})))"


def is_product_url(url: str, **patterns) -> Column:
    """Plain substring rules: any denied part rejects; then the allowed part or suffix accepts."""
    return F.expr(is_product_url_sql(url, **patterns))
