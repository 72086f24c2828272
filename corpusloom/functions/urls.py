"""Column functions over addresses: repository links, reference candidates, private addresses, service endpoints, errors."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------------------------
RESERVED_OWNERS = "orgs settings marketplace explore topics collections trending sponsors features pricing login join notifications new search apps".split()
OWNER, REPO = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$", r"^[A-Za-z0-9._-]{1,100}$"
LOCAL_NAMES = r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal|.*\.home\.arpa|metadata\.google\.internal)$"
ERROR_RULES = [
    ("context", r"context|too many tokens|maximum.*tokens|token limit|prompt is too long|input is too long|reduce the length", ()),
    ("auth", r"invalid api key|incorrect api key|no auth|unauthori[sz]ed|invalid_api_key", (401,)),
    ("credits", r"insufficient (credit|quota|funds|balance)|quota exceeded|billing|credits", (402,)),
    ("model", r"model.*(not found|does not exist|not available|invalid)|no endpoints found|unknown model", (404,)),
    ("rate_limit", r"rate.?limit|too many requests|overloaded", (429,)),
]


def repo_target(raw: Column, host: str = "github.com") -> Column:
    """Struct of owner, repo, tree_segments, points_at_file and error (null: usable)."""
    text = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    dotted = host.replace(".", r"\.")
    text = F.regexp_replace(text, rf"(?i)\Agit@{dotted}:(.+)\z", f"https://{host}/$1")
    bare = text.rlike(r"^[A-Za-z0-9-]+/[A-Za-z0-9._-]+/?$")
    full = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    found = F.regexp_replace(F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.when(bare, text).otherwise(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    segs = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    owner, repo = F.get(segs, 0), F.regexp_replace(F.get(segs, 1), r"(?i)\.git$", "")
    kind, rest = F.get(segs, 2), F.slice(segs, F.lit(4), F.greatest(F.size(segs) - 3, F.lit(0)))
    is_tree = F.coalesce(kind.isin("tree", "blob") & (F.size(rest) > 0), F.lit(False))
    tree = F.when(is_tree, rest).otherwise(F.array().cast("array<string>"))
    bad = F.exists(tree, lambda s: (s == ".") | F.contains(s, F.lit("..")) | s.rlike(r"[/\\]"))
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
        .when(~bare & (found != host), F.lit("host"))
        .when(F.size(segs) < 2, F.lit("not_a_repository"))
        .when(~owner.rlike(OWNER) | F.lower(owner).isin(RESERVED_OWNERS), F.lit("owner"))
        .when(~repo.rlike(REPO) | repo.isin(".", ".."), F.lit("repo"))
        .when(bad, F.lit("ref"))
    )
    ok = error.isNull()
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, repo).alias("repo"), F.when(ok, tree).alias("tree_segments"), (ok & is_tree & (kind == "blob")).alias("points_at_file"), error.alias("error"))


def ref_candidates(tree: Column, points_at_file: Column, most: int = 4) -> Column:
    """Array of (ref, subpath), shortest reference first."""

    def split(n: Column) -> Column:
        rest = F.slice(tree, n + 1, F.greatest(F.size(tree) - n, F.lit(0)))
        rest = F.when(points_at_file, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        return F.struct(F.array_join(F.slice(tree, F.lit(1), n), "/").alias("ref"), F.array_join(rest, "/").alias("subpath"))

    head = F.array(F.struct(F.lit("HEAD").alias("ref"), F.lit("").alias("subpath")))
    return F.when(F.size(tree) == 0, head).otherwise(F.transform(F.sequence(F.lit(1), F.least(F.size(tree), F.lit(most))), split))


def is_ipv4(ip: Column) -> Column:
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return ip.rlike(rf"^{part}(\.{part}){{3}}$")


def is_private_ipv4(ip: Column) -> Column:
    """F18, for dotted addresses; anything else counts as private."""
    b = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, c = F.get(b, 0), F.get(b, 1)
    private = (
        a.isin(0, 10, 127) | ((a == 100) & c.between(64, 127)) | ((a == 169) & (c == 254)) | ((a == 172) & c.between(16, 31))
        | ((a == 192) & c.isin(168, 0)) | ((a == 198) & c.isin(18, 19)) | (a >= 224)
    )
    return F.when(is_ipv4(ip), private).otherwise(F.lit(True))


def _private(text: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((text or "").split("%")[0])
    except ValueError:
        return True
    b = ip.packed
    if len(b) == 4:
        return _private_v4(b)
    if not any(b[:15]) and b[15] in (0, 1):
        return True
    if not any(b[:10]) and b[10:12] in (b"\xff\xff", b"\x00\x00"):
        return _private_v4(b[12:])
    if b[:4] == b"\x00\x64\xff\x9b" and not any(b[4:12]):
        return _private_v4(b[12:])
    if b[:2] == b"\x20\x02":
        return _private_v4(b[2:6])
    return b[0] & 0xFE == 0xFC or (b[0] == 0xFE and b[1] & 0xC0 == 0x80) or b[0] == 0xFF


def _private_v4(b: bytes) -> bool:
    first, second = b[0], b[1]
    ranges = {100: range(64, 128), 169: (254,), 172: range(16, 32), 192: (0, 168), 198: (18, 19)}
    return first in (0, 10, 127) or first >= 224 or second in ranges.get(first, ())


@F.pandas_udf(T.BooleanType())
def is_private_address_udf(ip: pd.Series) -> pd.Series:
    """F18, for addresses of both versions."""
    return ip.map(_private).astype(bool)


def relay_target_error(raw: Column, self_host: Column | None = None, allow_http: bool = False) -> Column:
    """why a service address is refused, or null."""
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(authority, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when(raw.isNull() | (F.length(raw) > 500), F.lit("missing"))
        .when((scheme == "") | (host == ""), F.lit("invalid"))
        .when((scheme != "https") & ~(F.lit(allow_http) & (scheme == "http")), F.lit("scheme"))
        .when(F.contains(authority, F.lit("@")), F.lit("credentials"))
        .when(F.contains(raw, F.lit("?")) | F.contains(raw, F.lit("#")), F.lit("query"))
        .when(F.lit(False) if self_host is None else F.lower(F.regexp_replace(authority, r"^.*@", "")) == F.lower(self_host), F.lit("self"))
        .when(bare.rlike(LOCAL_NAMES), F.lit("local"))
        .when(is_ipv4(bare) & is_private_ipv4(bare), F.lit("private"))
    )


def error_kind(status: Column, message: Column) -> Column:
    """The first rule that fits; a too-long request is not judged by its words when it was one too many."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(low.rlike(ERROR_RULES[0][1]) & (status != 429), F.lit("context"))
    for kind, pattern, codes in ERROR_RULES[1:]:
        out = out.when(status.isin(*codes) | low.rlike(pattern), F.lit(kind))
    return out.when(status == 403, F.lit("auth")).when((status >= 500) | status.isin(408, 409, 425), F.lit("server")).otherwise(F.lit("bad_request"))


def is_retryable(kind: Column) -> Column:
    """N3."""
    return kind.isin("rate_limit", "server", "network", "empty")


def retry_after_ms(header: Column) -> Column:
    """A delay in seconds as milliseconds between 0 and 120 000, or null."""
    seconds = header.try_cast("double")
    return F.when(seconds.isNotNull(), F.least(F.lit(120_000.0), F.greatest(F.lit(0.0), seconds * 1000)).cast("long"))


def backoff_ms(kind: Column, attempt: Column, jitter: Column) -> Column:
    """min(60 s, base * 2^attempt) * (0.75 + jitter / 2)."""
    base = F.when(kind == "rate_limit", 4000.0).otherwise(1500.0)
    return F.least(F.lit(60_000.0), base * F.pow(F.lit(2.0), attempt)) * (F.lit(0.75) + jitter * 0.5)


def normalise_base_url(raw: Column) -> Column:
    """With a scheme, without trailing slashes and without the chat endpoint's own path."""
    text = F.regexp_replace(F.trim(raw), r"/+$", "")
    text = F.when((text != "") & ~text.rlike(r"(?i)^https?://"), F.concat(F.lit("https://"), text)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, r"/chat/completions$", ""), r"/+$", "")


def chat_endpoint(base: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/chat/completions"))
