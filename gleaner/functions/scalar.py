"""Scalar functions: sizes, addresses, vectors, token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as tx

# Words that say nothing about a result's identity.
STOP_WORDS = ("the", "and", "for", "with", "official", "video", "audio", "hd", "full", "new", "free", "download", "watch", "online")
UNITS = ("B", "KB", "MB", "GB", "TB")


def parse_size(c: Column | str) -> Column:
    """Bytes of "1.4 GB" and the like, every unit being 1024 of the last; null where there is no size."""
    pattern = r"(?i)([\d.,]+)\s*(KiB|MiB|GiB|TiB|KB|MB|GB|TB|B)"
    amount = F.regexp_replace(F.regexp_extract(tx.col(c), pattern, 1), ",", "").try_cast("double")
    unit = F.upper(F.substring(F.regexp_extract(tx.col(c), pattern, 2), 1, 1))
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.floor(amount * scale).cast("long")


def human_size(c: Column | str) -> Column:
    """Bytes as B, or with one decimal as KB to TB."""
    n = tx.col(c).cast("double")
    out = F.when(n < 1024, F.concat(tx.col(c).cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS[1:], 1):
        fits = F.lit(True) if unit == UNITS[-1] else n < 1024.0 ** (i + 1)
        out = out.when(fits, F.format_string("%.1f " + unit, n / 1024.0**i))
    return out


def url_encode(c: Column | str) -> Column:
    """Percent-encoded, spaces too."""
    return F.replace(F.url_encode(tx.col(c)), F.lit("+"), F.lit("%20"))


def unwrap_redirect(c: Column | str, marker: str = "uddg=") -> Column:
    """The address inside a search engine's redirect; the same where there is none or it cannot be decoded."""
    c = tx.col(c)
    inner = F.substring_index(F.substring(c, F.instr(c, marker) + len(marker), 1 << 30), "&", 1)
    return F.when(F.instr(c, marker) > 0, F.coalesce(F.try_url_decode(inner), c)).otherwise(c)


def url_key(c: Column | str) -> Column:
    """Identity of a result's address: no fragment, trimmed, lower case, one slash off the end."""
    return F.regexp_replace(F.lower(tx.trim(tx.before_hash(c))), r"/\z", "")


def page_key(c: Column | str) -> Column:
    """Identity of a hit across result pages: no fragment, all slashes off the end, lower case."""
    return F.lower(F.regexp_replace(tx.before_hash(c), r"/+\z", ""))


def clean_url(c: Column | str) -> Column:
    """A cell's address, trimmed, without fragment and final slashes; what does not start with http is kept."""
    t = tx.trim(c)
    return F.when(t.startswith("http"), F.regexp_replace(tx.before_hash(t), r"/+\z", "")).otherwise(tx.col(c))


def extension(c: Column | str) -> Column:
    """Lower-case file extension of an address; empty where there is none."""
    return F.lower(F.regexp_extract(tx.col(c), r"(?i)\.([a-z0-9]{2,5})(?:\?|#|\z)", 1))


def title_case(c: Column | str) -> Column:
    """Each space-separated word with its first letter in upper case and the rest in lower case."""
    return F.initcap(tx.col(c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors within [-1, 1]; 0 where either is null, empty or zero, or their lengths differ."""
    a, b = tx.col(a), tx.col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    found = F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms)
    return F.when(found.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found))).otherwise(F.lit(0.0))


def normalize(a: Column | str) -> Column:
    """The vector at length 1; a zero vector as it is."""
    a = tx.col(a)
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def tokens(c: Column | str) -> Column:
    """Set of the lower-case words of three characters or more that are no stop words."""
    words = F.split(F.lower(tx.col(c)), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def token_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(tokens(a), tokens(b))


def trigrams(c: Column | str) -> Column:
    """Set of the three-character runs of the text with two spaces before and one behind."""
    p = F.concat(F.lit("  "), tx.col(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def title_overlap(title: Column | str, subject: Column | str) -> Column:
    """How many of the subject's words of three letters or more the title has."""
    want = F.array_distinct(F.filter(F.split(F.lower(tx.col(subject)), " "), lambda w: F.length(w) > 2))
    return F.size(F.array_intersect(want, F.split(F.lower(tx.col(title)), r"[^\p{L}\p{N}]+")))


def encode_map(c: Column | str) -> Column:
    """A map of strings as JSON; a null map as an empty object."""
    return F.coalesce(F.to_json(tx.col(c)), F.lit("{}"))


def decode_map(c: Column | str) -> Column:
    """A map of strings from JSON; empty where it is none."""
    return F.coalesce(F.from_json(tx.col(c), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
