"""URL normalisation, resolution and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratetally.functions.dates import found
from ratetally.functions.text import bind, slug, strip, text

# File extensions of published documents.
FILE_EXTENSIONS = ["pdf", "xlsx", "xls", "csv", "zip", "docx", "doc"]
CATALOG_EXTENSIONS = ["pdf", "xlsx", "xls", "csv", "zip"]

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, PARTS, 1))


def host(c: Column) -> Column:
    """Network location (host and port) as written."""
    return F.regexp_extract(c, PARTS, 2)


def path(c: Column) -> Column:
    return F.regexp_extract(c, PARTS, 3)


def query(c: Column) -> Column:
    return F.regexp_extract(c, PARTS, 4)


def _form_encode(c: Column) -> Column:
    e = F.url_encode(c)
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(q: Column) -> Column:
    def pair(item):
        k = F.regexp_extract(item, r"^([^=]*)", 1)
        v = F.regexp_replace(item, r"^[^=]*=?", "")
        return F.struct(
            F.coalesce(F.try_url_decode(k), k).alias("k"),
            F.coalesce(F.try_url_decode(v), v).alias("v"),
        )

    pairs = F.array_sort(F.transform(F.filter(F.split(q, "&"), lambda i: i != ""), pair))
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&"
    )


def normalize_url(c: Column) -> Column:
    """Canonical URL: lower-case scheme and host, no trailing slash or fragment, sorted query pairs."""
    s = strip(c)
    sch = scheme(s)
    p = F.regexp_replace(F.regexp_replace(path(s), r";[^/]*$", ""), r"/+$", "")
    p = F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    q = query(s)
    sorted_q = F.when(q != "", F.concat(F.lit("?"), _sorted_query(q))).otherwise(F.lit(""))
    url = F.concat(
        F.when(sch == "", F.lit("https")).otherwise(sch), F.lit("://"), F.lower(host(s)), p,
        F.when(sorted_q == "?", F.lit("")).otherwise(sorted_q),
    )
    return F.when(s == "", F.lit("")).otherwise(url)


def drop_fragment(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"#.*$", ""))


def _without_dots(p: Column) -> Column:
    """Resolve ``.``, ``..`` and empty inner segments of an absolute path."""
    last_is_dot = p.rlike(r"(^|/)\.{1,2}$")
    kept = F.aggregate(
        F.filter(F.split(p, "/"), lambda seg: seg != ""),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when((last_is_dot | p.endswith("/")) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)|//"), resolved).otherwise(p)


def join_url(base: Column, href: Column) -> Column:
    """``href`` seen from the page ``base``; other schemes (mailto, javascript) are returned as they are."""
    parts = F.struct(strip(base).alias("b"), strip(href).alias("h"))

    def resolve(x):
        b, h = x["b"], x["h"]
        origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        base_path = F.regexp_extract(b, PARTS, 3)
        folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
        h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
        h_rest = F.regexp_replace(h, r"^[^?#]*", "")
        return (
            F.when(h == "", b)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([^/]*)", 1), h))
            .when(h.startswith("/"), F.concat(origin, _without_dots(h_path), h_rest))
            .when(h.startswith("?"), F.concat(origin, base_path, h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, h_path)), h_rest))
        )

    return bind(parts, resolve)


def is_script_url(c: Column) -> Column:
    s = F.lower(strip(c))
    return s.startswith("javascript:") | s.contains("__dopostback")


def absolute_url(base: Column, href: Column) -> Column:
    """File link of a catalog row: the base is read as a folder, script links become ''."""
    b, h = strip(base), strip(href)
    folder = F.concat(F.regexp_replace(b, r"/+$", ""), F.lit("/"))
    return (
        F.when(h == "", F.lit(""))
        .when(h.rlike(r"^https?://"), h)
        .when(is_script_url(h) | (b == ""), F.lit(""))
        .otherwise(join_url(folder, h))
    )


def is_http_url(c: Column) -> Column:
    return strip(c).rlike(r"^(?i)https?://")


def has_file_extension(c: Column, extensions=FILE_EXTENSIONS) -> Column:
    """True when the path of the URL ends in one of the extensions."""
    return F.lower(path(strip(c))).rlike(r"\.(" + "|".join(extensions) + r")$")


_DOCUMENT = r"\.(" + "|".join(FILE_EXTENSIONS) + ")"
# Signs of a URL that returns a document; of one row, the path and the whole URL must show what is stated.
DOCUMENT_SIGNS = [
    (_DOCUMENT + "$", None),
    (r"attachment\.do|getfile|download\.aspx|filedownload", None),
    (r"(?s)/media/.*" + _DOCUMENT + "|" + _DOCUMENT + ".*/media/", None),
    (r"\.ashx", "pdf|xlsx|xls|csv"),
    ("export", "(format|type)=(pdf|xlsx)"),
    (None, r"pubatt/dl/|/api/now/attachment/.*/file|sys_attachment\.do"),
    (None, "(format|filetype|type)=pdf|content-?type=application/pdf"),
]
# What a URL holds and the kind of link that it is; the first row that fits counts.
LINK_KINDS = [
    ("javascript:|__dopostback", "portal"), (r"[./]pdf", "pdf"), (r"\.xlsx", "xlsx"), (r"\.xls", "xls"), (r"\.csv", "csv"), (r"\.zip", "zip"),
    ("^https?://", "http"), ("", "other"),
]


def is_file_url(c: Column) -> Column:
    """URL that is likely to return a document: one of ``DOCUMENT_SIGNS``."""
    low = F.lower(strip(c))

    def signs(x):
        shown = lambda pattern, where: F.lit(True) if pattern is None else x[where].rlike(pattern)
        return x["u"].startswith("http") & any_true([shown(in_path, "p") & shown(in_url, "u") for in_path, in_url in DOCUMENT_SIGNS])

    return bind(F.struct(low.alias("u"), path(low).alias("p")), signs)


def any_true(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def link_kind(c: Column) -> Column:
    """Coarse kind of a link, by ``LINK_KINDS``."""
    u = F.lower(strip(c))
    return F.coalesce(*[F.when(u.rlike(pattern), kind) for pattern, kind in LINK_KINDS], F.lit(LINK_KINDS[-1][1]))


# Header words and the link kinds they announce.
HEADER_KINDS = [
    (r"excel|xls|spreadsheet|workbook|csv", ["xls", "xlsx", "csv"]),
    (r"pdf|acrobat|adobe", ["pdf"]),
    (r"zip|archive|compressed", ["zip"]),
    (r"download|attachment|document|file|format|resource|manual|publication|link", ["any_http"]),
]
VIEW_HEADER_KINDS = [
    (r"\bexcel\b|spreadsheet|workbook|\bxls\b|\.xls", ["xls", "xlsx"]),
    (r"\bcsv\b", ["csv"]),
    (r"pdf|acrobat|adobe", ["pdf"]),
    (r"zip|archive|compressed", ["zip"]),
    (r"download|attachment|document|\bfile\b|format|resource|manual|publication|hyperlink|\blink\b", ["any_http"]),
]
HTTP_KINDS = ["pdf", "xls", "xlsx", "csv", "zip", "http"]


def expected_kinds(header: Column, table=HEADER_KINDS) -> Column:
    """ARRAY of link kinds a column with this header is expected to hold."""
    t = F.lower(strip(header))
    empty = F.array().cast("array<string>")
    return F.concat(*[
        F.when(t.rlike(pattern), F.array(*[F.lit(k) for k in kinds])).otherwise(empty) for pattern, kinds in table
    ])


def kind_fits(kind: Column, kinds: Column) -> Column:
    """True when a link of ``kind`` satisfies a column expecting ``kinds``; xls and xlsx stand for each other."""
    sheet = F.arrays_overlap(kinds, F.array(F.lit("xls"), F.lit("xlsx")))
    return (
        F.array_contains(kinds, kind)
        | (kind.isin("xls", "xlsx") & sheet)
        | (kind.isin(HTTP_KINDS) & F.array_contains(kinds, F.lit("any_http")))
    )


def kind_name(c: Column) -> Column:
    """File type of a URL by the end of its path, else ``unknown``."""
    hit = F.regexp_extract(F.lower(path(strip(c))), r"\.(pdf|xlsx|xls|csv|zip)$", 1)
    return F.when(hit == "", F.lit("unknown")).otherwise(hit)


def leaf_name(c: Column) -> Column:
    """Safe file name of the last path part."""
    p = F.regexp_replace(path(strip(c)), r"/+$", "")
    leaf = F.regexp_extract(p, r"([^/]*)$", 1)
    leaf = F.coalesce(F.try_url_decode(F.replace(leaf, F.lit("+"), F.lit("%2B"))), leaf)
    leaf = F.when(leaf == "", F.lit("download")).otherwise(leaf)
    return F.regexp_replace(leaf, r"[^A-Za-z0-9._-]+", "_")


def stem(leaf: Column) -> Column:
    """File name without a short alphanumeric extension; a leading dot does not start one."""
    s = strip(leaf)
    cut = F.regexp_replace(s, r"(?<=.)\.[A-Za-z0-9]{1,6}$", "")
    return F.when(s == "", F.lit("download")).otherwise(cut)


def guess_extension(url: Column, content_type: Column) -> Column:
    """Extension by URL, else by content type, else ''."""
    u = F.regexp_extract(F.lower(text(url)), r"^([^?]*)", 1)
    ct = F.lower(F.trim(F.split(text(content_type), ";")[0]))
    out = F.when(ct.contains("pdf"), ".pdf").when(ct.rlike("spreadsheet|excel|sheet"), ".xlsx")
    out = out.when(ct.contains("csv"), ".csv").when(ct.contains("html"), ".html").otherwise("")
    for ext in reversed(["pdf", "xlsx", "xls", "csv", "zip", "json"]):
        out = F.when(u.contains("." + ext), F.lit("." + ext)).otherwise(out)
    return out


def is_opaque_name(c: Column) -> Column:
    """File names that are only a long hexadecimal number or a UUID."""
    s = strip(c)
    bare = F.regexp_replace(s, r"[-_.]", "")
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return bare.rlike(r"(?i)^[a-f0-9]{28,}$") | s.rlike(uuid)


def safe_stem(c: Column) -> Column:
    """User-facing file stem without path, known extension and reserved characters."""
    s = F.regexp_replace(text(c), "[–—]", "-")
    s = F.regexp_extract(F.replace(s, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    s = F.regexp_replace(F.rtrim(s), r"(?i)\.(xlsx|xls|pdf|csv|zip|html)$", "")
    s = F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ ._]+|[ ._]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_+|_+$", "")
    return F.regexp_replace(s, r"[ ._]+$", "")


def folder_slug(c: Column) -> Column:
    """Folder name of a key."""
    s = F.lower(strip(c))
    s = F.when(s == "", F.lit("fee_schedule")).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(s == "", F.lit("fee_schedule")).otherwise(s)


def stored_path(state: Column, key: Column, date_prefix: Column, sha256: Column, leaf: Column) -> Column:
    """Relative path of a stored version: state / key / day__hash_name."""
    st = F.lower(F.coalesce(F.nullif(strip(state), F.lit("")), F.lit("unknown")))
    name = F.concat(date_prefix, F.lit("__"), F.substring(sha256, 1, 16), F.lit("_"), leaf)
    return F.concat_ws("/", st, folder_slug(key), name)


def download_name(label: Column, filename: Column, artifact_id: Column, ext: Column) -> Column:
    """File name offered to a user: label when it says something, else the stored name, else the id."""
    lab = strip(label)
    from_label = F.when((F.length(lab) > 2) & ~F.lower(lab).isin("download", "download file", "click here", "here", "file"), F.nullif(safe_stem(lab), F.lit("")))
    by_id = F.when(artifact_id != 0, F.concat(F.lit("fee_schedule_"), artifact_id.cast("string")))
    file_part = F.regexp_replace(F.regexp_extract(strip(filename), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    from_name = F.when((file_part != "") & ~is_opaque_name(file_part), F.nullif(safe_stem(file_part), F.lit("")))
    fallback = F.coalesce(by_id, F.when(is_opaque_name(file_part), F.lit("fee_schedule")), F.lit("fee_schedule_download"))
    return F.concat(F.coalesce(from_label, from_name, fallback), text(ext))


def candidate_key(section_slug: Column, row_title: Column, link_text: Column) -> Column:
    """Grouping key of a file link: its section, else its own text unless generic, else the row title."""
    from ratetally.functions.text import is_generic_link_text

    title, label = strip(row_title), strip(link_text)
    named = F.when((title != "") & is_generic_link_text(label), slug(title)).when(
        ~is_generic_link_text(label), slug(label)
    ).when(title != "", slug(title)).otherwise(F.lit("fee_schedule"))
    return F.when(strip(section_slug) != "", strip(section_slug)).otherwise(named)
