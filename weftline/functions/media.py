"""Media types, capture predicates and sizes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a capture keeps and how types are named.
KEPT_TYPES = ("text/html", "text/css", "application/javascript", "text/javascript", "application/x-javascript", "application/manifest+json", "application/json", "application/octet-stream", "model/", "image/", "font/", "application/font", "application/x-font", "audio/", "video/", "application/wasm")
STATIC_EXTENSIONS = "avif basis bin bmp css dds drc eot exr fbx gif glb gltf hdr ico jpeg jpg js ktx2? meshopt mjs mp3 mp4 obj ogg otf ply png svg tga ttf usdz vrm wasm wav webm webp woff2?".split()
TRACKERS = ("google-analytics", "googletagmanager", "analytics", r"mc\.yandex", "metrika", "hotjar", "segment", "amplitude", "mixpanel", r"facebook\.net", r"connect\.facebook", r"clarity\.ms", "sentry")
EXTENSIONS = {
    "text/html": ".html", "text/css": ".css", "application/wasm": ".wasm", "application/manifest+json": ".webmanifest", "application/json": ".json", "image/svg+xml": ".svg", "image/png": ".png",
    "image/jpeg": ".jpg", "image/webp": ".webp", "image/avif": ".avif", "image/gif": ".gif", "font/woff2": ".woff2", "font/woff": ".woff",
}
COMPRESSED = r"(^|/)(audio|video|image)/|font/(woff2?|otf)|application/(wasm|zip|gzip|pdf)|\.(avif|br|gif|gz|jpe?g|mp3|mp4|ogg|png|webm|webp|woff2?|zip)($|[?#])"
TEXT_PATHS = r"\.(css|html?|js|json|map|svg|txt|xml)$"
LARGE_MEDIA_BYTES = 25 * 1024 * 1024
RETRIED_STATUS = (408, 425, 429, 500, 502, 503, 504)


def normalized_type(value: Column) -> Column:
    """Before the first semicolon, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.split_part(F.coalesce(value, F.lit("")), F.lit(";"), F.lit(1))))


def header(headers: Column, name: str) -> Column:
    """The first value of a header whatever its case; empty if there is none."""
    own = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(own, F.lit(0))["value"], F.lit(""))


def should_capture(url: Column, mime: Column, resource_type: Column, page_origin: Column, url_origin: Column) -> Column:
    kind = F.lower(F.coalesce(mime, F.lit("")))
    kept = F.rlike(kind, F.lit("^(" + "|".join(k.replace("+", r"\+") for k in KEPT_TYPES) + ")"))
    static = F.rlike(F.lower(url), F.lit(r"\.(" + "|".join(STATIC_EXTENSIONS) + r")($|[?#])"))
    foreign = (resource_type == "Document") & (page_origin != "") & (url_origin != page_origin)
    return F.rlike(F.lower(url), F.lit("^https?:")) & ~foreign & (kept | F.contains(kind, F.lit("json")) | static)


def is_tracker(url: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(url, F.lit(""))), F.lit("|".join(TRACKERS)))


def is_catalog_text(url: Column, mime: Column) -> Column:
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.startswith(kind, F.lit("text/")) | F.rlike(kind, F.lit(r"(java|ecma)script|json|xml|gltf\+json")) | is_gltf_url(url)


def is_optimizer_text(mime: Column) -> Column:
    kind = normalized_type(mime)
    return F.startswith(kind, F.lit("text/")) | F.rlike(kind, F.lit("(java|ecma)script|json|xml|svg|gltf"))


def is_gltf_url(url: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(url, F.lit(""))), F.lit(r"\.gltf($|[?#])"))


def is_source_map(url: Column, mime: Column) -> Column:
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.rlike(F.lower(F.coalesce(url, F.lit(""))), F.lit(r"\.map($|[?#])")) | F.rlike(kind, F.lit(r"\.map($|[?#])|(application|text)/json[^;]*;?[^\n]*source-?map"))


def is_large_media(mime: Column, size: Column, threshold: int = LARGE_MEDIA_BYTES) -> Column:
    return F.rlike(normalized_type(mime), F.lit("^(audio|video)/")) & (size >= threshold)


def extension(mime: Column) -> Column:
    kind = F.lower(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1)))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(F.rlike(kind, F.lit("(java|ecma)script")), ".js").otherwise(F.coalesce(table[kind], F.lit("")))


def body_size(body: Column, base64_encoded: Column) -> Column:
    """Bytes of a body as text, or of what its base64 stands for; null is 0."""
    padding = F.when(F.endswith(body, F.lit("==")), 2).when(F.endswith(body, F.lit("=")), 1).otherwise(0)
    decoded = F.greatest(F.lit(0), F.floor(F.length(body) * 3 / 4) - padding)
    return F.coalesce(F.when(base64_encoded, decoded).otherwise(F.octet_length(body)), F.lit(0)).cast("long")


def format_bytes(n: Column) -> Column:
    """B, KB or MB with one decimal, rounded half up on tenths."""
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")
    tenths = lambda unit: F.floor((n * 20 + unit) / (2 * unit)).cast("long")
    text = lambda unit, name: F.concat(F.floor(tenths(unit) / 10).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, text(1024, " KB")).otherwise(text(1024 * 1024, " MB"))


def scaled_bytes(n: Column) -> Column:
    """B to TB by powers of 1024, with one decimal but for bytes; nothing and less are 0 B."""
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")
    shown = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = 1024**power
        tenths = F.floor((n % size * 20 + size) / (2 * size)) + F.floor(n / size) * 10
        shown = F.when(n >= size, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(shown)
    return shown


def header_map(headers: Column) -> Column:
    """Headers (array of name, value) as a map; of a repeated name the last counts."""
    names = F.array_distinct(F.transform(headers, lambda h: F.coalesce(h["name"], F.lit(""))))
    last = lambda name: F.element_at(F.filter(headers, lambda h: F.coalesce(h["name"], F.lit("")) == name), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(last(n), F.lit("")))), F.create_map().cast("map<string,string>"))


@F.pandas_udf(T.LongType())
def deflated_size(bodies: pd.Series) -> pd.Series:
    """Bytes that raw DEFLATE of level 6 makes of each body; null stays null."""

    def size(body: bytes | None) -> int | None:
        if body is None:
            return None
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return len(packer.compress(body)) + len(packer.flush())

    return pd.Series([size(b) for b in bodies], dtype="Int64")


def estimated_size(path: Column, mime: Column, size: Column) -> Column:
    """Compressed size by ratio: 0.99 of what is compressed already, 0.52 of text, 0.82 of the rest; in whole hundredths, rounded up."""
    hint = F.lower(F.concat(F.coalesce(mime, F.lit("")), F.lit("/"), path))
    ratio = F.when(F.rlike(hint, F.lit(COMPRESSED)), 99).when(is_optimizer_text(mime) | F.rlike(F.lower(path), F.lit(TEXT_PATHS)), 52).otherwise(82)
    return F.floor((size * ratio + 99) / 100).cast("long")


def is_retried(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRIED_STATUS), F.lit(False))


def credentials(url_origin: Column, page_origin: Column) -> Column:
    return F.when(url_origin == page_origin, "include").otherwise("omit")
