"""String columns: names, domains, URLs, tokens and sensitive text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import fixed_values as fv


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    c = col(c)
    return F.when(c != "", c)


def lookup(mapping: dict, key: Column) -> Column:
    """Literal-map lookup; NULL for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of_rx(words) -> str:
    """One alternation over literal words (a single pass over the text)."""
    specials = "\\.^$|()[]{}*+?"
    return "|".join("".join("\\" + ch if ch in specials else ch for ch in w) for w in words)


def canonical_app_name(name) -> Column:
    """Drop one trailing ``(...)`` unless nothing would be left."""
    name = col(name)
    base = strip(F.regexp_replace(name, r"(?U)\s*\([^)]*\)\s*$", ""))
    return F.coalesce(blank_to_null(base), name)


def canonical_domain(domain) -> Column:
    """Trimmed, lower case, no scheme, path or leading ``www.``."""
    d = F.regexp_replace(F.lower(strip(domain)), "^https?://", "")
    return F.regexp_replace(F.substring_index(d, "/", 1), r"^www\.", "")


def utc_timestamp(text) -> Column:
    """ISO text to TIMESTAMP; text without a zone is read as UTC."""
    return F.try_to_timestamp(col(text))


def truthy(c) -> Column:
    """P8."""
    return F.coalesce(F.lower(strip(col(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def clean_marker(c) -> Column:
    """``none``, ``nan`` and blank become NULL; every other value stays."""
    c = col(c)
    return F.when(~F.lower(strip(c)).isin("none", "nan", ""), c)


def clean_number(c) -> Column:
    """P9 for numbers: NaN becomes NULL, 0 stays."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def url_authority(url) -> Column:
    """The part between ``//`` and the path, with user info and port."""
    # Control characters and blanks in front, and tabs or line breaks anywhere, are ignored.
    u = F.regexp_replace(F.regexp_replace(col(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    u = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u))
    host = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    balanced = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return F.when((col(url) != "") & balanced, blank_to_null(host))


def url_activity(url) -> Column:
    """struct(event_type, label, reason); the first hint in list order wins."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    page = F.substring_index(u, "?", 1)
    hint = F.coalesce(*[F.when(F.contains(u, F.lit(h)), F.lit(h)) for h in fv.UPLOAD_DOMAIN_HINTS])
    ext = F.coalesce(*[F.when(F.endswith(page, F.lit(e)), F.lit(e)) for e in fv.DOWNLOAD_EXTENSIONS])
    label = F.when(hint.isNotNull(), "upload").when(ext.isNotNull(), "download").otherwise("browse")
    kind = (F.when(hint.isNotNull(), "cloud_upload").when(ext.isNotNull(), "file_transfer")
            .otherwise("browser_activity"))
    reason = F.coalesce(F.concat(F.lit("domain_hint:"), hint),
                        F.concat(F.lit("url_extension:"), ext), F.lit("no_hint_matched"))
    return F.struct(kind.alias("event_type"), label.alias("label"), reason.alias("reason"))


def windows_user(c) -> Column:
    """The part after the first backslash, else the text, else ``unknown``."""
    c = col(c)
    return F.coalesce(
        F.when(F.contains(c, F.lit("\\")), F.regexp_extract(c, r"(?s)^[^\\]*\\(.*)$", 1)),
        blank_to_null(c), F.lit("unknown"))


def department_of_host(host) -> Column:
    """``FINANCE`` in ``WIN10-FINANCE-07`` as ``Finance``."""
    dept = F.regexp_extract(F.coalesce(col(host), F.lit("")), r"^[A-Z0-9]+-([A-Z]+)-\d+$", 1)
    return F.when(dept != "", F.initcap(dept)).otherwise("Unclassified")


def catalogue_key(domain) -> Column:
    """Lower case, trimmed, no dot at the end."""
    return F.rtrim(strip(F.lower(col(domain))), F.lit("."))


def domain_token(domain, key: str) -> Column:
    """HMAC-SHA256 of the catalogue key, in hex, inside codegen."""
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in secret))
    outer = F.lit(bytearray(b ^ 0x5C for b in secret))
    message = F.encode(catalogue_key(domain), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, digest), 256)


def redact(c) -> Column:
    """Credential headers and cloud keys out of a log line.

    The patterns run only on texts that contain one of their words.
    """
    c = col(c)
    lower = F.lower(c)
    named = [F.contains(lower, F.lit(w)) for w in ("authorization", "x-api-key", "token", "password")]
    headers = F.when(named[0] | named[1] | named[2] | named[3],
                     F.regexp_replace(c, fv.REDACT_HEADER, "$1=[REDACTED]")).otherwise(c)
    return F.when(F.contains(headers, F.lit("AKIA")),
                  F.regexp_replace(headers, fv.REDACT_CLOUD_KEY, "[REDACTED_AWS_KEY]")).otherwise(headers)


def _unicode(pattern: str) -> str:
    """Words, digits and blanks of every script, as the patterns assume."""
    return "(?U)" + pattern


def _luhn_valid(candidate: Column) -> Column:
    digits = F.reverse(F.regexp_replace(candidate, "[^0-9]", ""))
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, d).otherwise(doubled)

    checksum = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return n.between(13, 19) & (checksum % 10 == 0)


# A text that a pattern can match contains this piece; a plain search for it is far
# cheaper than the pattern, and most texts have none. Pieces marked upper are searched
# in the upper-case text.
_PIECE = {"api_key": ("API", True), "password": ("PASSWORD", True), "jwt": ("eyJ", False),
          "aws_key": ("AKIA", False), "ssn": ("-", False), "connection_string": ("://", False)}


def scan_text(text) -> Column:
    """Struct of match counts per detector over the whole text; never the matches."""
    text = F.coalesce(col(text), F.lit(""))
    upper = F.upper(text)

    def count(pattern, piece, in_upper=False):
        return F.when(F.contains(upper if in_upper else text, F.lit(piece)),
                      F.regexp_count(text, F.lit(_unicode(pattern)))).otherwise(0)

    counts = {name: count(rx, *_PIECE[name]) for name, rx in fv.TEXT_DETECTORS.items()}
    cards = F.filter(F.regexp_extract_all(text, F.lit(_unicode(fv.CARD_PATTERN)), 0), _luhn_valid)
    counts["credit_card"] = F.size(cards)
    mails = count(fv.EMAIL_PATTERN, "@")
    counts["email_list"] = F.when(mails >= fv.EMAIL_LIST_MINIMUM, mails).otherwise(0)
    return F.struct(*[n.cast("long").alias(name) for name, n in counts.items()])


def summarize_scan(counts: Column) -> Column:
    """Counts of :func:`scan_text` as struct(classification, detectors, match_count)."""
    names = sorted([*fv.TEXT_DETECTORS, "credit_card", "email_list"])
    hits = F.array_compact(F.array(*[F.when(counts[n] > 0, F.lit(n)) for n in names]))
    total = sum((counts[n] for n in names[1:]), counts[names[0]])
    severe = F.arrays_overlap(hits, F.array(*[F.lit(n) for n in fv.HIGHLY_CONFIDENTIAL]))
    label = (F.when(severe, "highly_confidential").when(F.size(hits) > 0, "confidential")
             .otherwise("public"))
    return F.struct(label.alias("classification"), hits.alias("detectors"), total.alias("match_count"))


def scan_documents(df, text="text"):
    """P17 over a table: adds classification, detectors and match_count.

    The counts are computed once per row and then summarized, so no pattern runs twice.
    """
    staged = df.withColumn("_scan", scan_text(text))
    return (staged.withColumn("_sum", summarize_scan(F.col("_scan")))
            .select(*df.columns, F.col("_sum.classification"), F.col("_sum.detectors"),
                    F.col("_sum.match_count")))
