"""URL expressions: parts, registry base normal form, request URLs, download URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lower_ascii, percent_encode

# Fixed values.
REPOSITORY_HOSTS = ("github.com", "gitlab.com")
LOOPBACK_HOSTS = ("localhost", "127.0.0.1", "[::1]")
DEFAULT_PORTS = {"https": 443, "http": 80}
API_PATH = "/v0.1/servers"
# End of fixed values.

_SCHEME = r"(?s)\A(.+?)://"
_BRACKETED = r"\A(\[[^\]]*\])(?::([0-9]+))?\z"
_PLAIN = r"(?s)\A(.*):([0-9]+)\z"


def _port(text: Column) -> Column:
    return F.regexp_replace(text, r"\A0+(?=[0-9])", "").try_cast("bigint")


def url_parts(url: Column | str, derive_repository: bool = False) -> Column:
    """``struct(scheme, host, port, owner, repository_name)``; parts that do not parse are NULL.

    Credentials, a bad port or an empty host leave only the parts before them.
    """
    c = col(url)
    scheme = F.nullif(F.regexp_extract(c, _SCHEME, 1), F.lit(""))
    known = c.isNotNull() & ~F.startswith(c, F.lit("://")) & scheme.isNotNull()
    rest = F.regexp_replace(c, _SCHEME, "")
    authority = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    usable = known & (authority != "") & ~F.contains(authority, F.lit("@"))
    bracketed = F.startswith(authority, F.lit("["))
    has_colon = F.contains(authority, F.lit(":"))
    port_text = (
        F.when(bracketed, F.regexp_extract(authority, _BRACKETED, 2))
        .when(has_colon, F.regexp_extract(authority, _PLAIN, 2))
        .otherwise(F.lit(""))
    )
    port = F.when(port_text != "", _port(port_text))
    shape_ok = (
        F.when(bracketed, authority.rlike(_BRACKETED))
        .when(has_colon, authority.rlike(_PLAIN))
        .otherwise(F.lit(True))
    )
    port_ok = (port_text == "") | F.coalesce(port <= 65535, F.lit(False))
    ok = usable & shape_ok & port_ok
    host_text = (
        F.when(bracketed, F.regexp_extract(authority, _BRACKETED, 1))
        .when(has_colon, F.regexp_extract(authority, _PLAIN, 1))
        .otherwise(authority)
    )
    host = F.when(ok & (host_text != ""), lower_ascii(host_text))
    fields = [
        F.when(known, lower_ascii(scheme)).alias("scheme"),
        host.alias("host"),
        F.when(ok, port.cast("int")).alias("port"),
    ]
    if derive_repository:
        after = F.substring(rest, F.length(authority) + 2, F.lit(2**31 - 1))
        path = F.regexp_extract(after, r"\A([^?#]*)", 1)
        two = r"(?s)\A([^/]+)/([^/]+)\z"
        name = F.regexp_replace(F.regexp_extract(path, two, 2), r"\.git\z", "")
        derived = F.coalesce(host.isin(*REPOSITORY_HOSTS) & path.rlike(two) & (name != ""), F.lit(False))
        fields += [
            F.when(derived, F.regexp_extract(path, two, 1)).alias("owner"),
            F.when(derived, name).alias("repository_name"),
        ]
    return F.struct(*fields)


def registry_base(url: Column | str) -> Column:
    """``struct(scheme, host, port, base_path, normalized, error)`` of a registry base URL."""
    c = col(url)
    sep = F.position(F.lit("://"), c)
    scheme = lower_ascii(F.substring(c, F.lit(1), sep - 1))
    rest = F.substring(c, sep + 3, F.lit(2**31 - 1))
    authority = F.regexp_extract(rest, r"\A([^/?]*)", 1)
    tail = F.substring(rest, F.length(authority) + 1, F.lit(2**31 - 1))
    bracketed = F.startswith(authority, F.lit("["))
    colons = F.length(authority) - F.length(F.replace(authority, F.lit(":"), F.lit("")))
    host = lower_ascii(
        F.when(bracketed, F.regexp_extract(authority, r"\A(\[[^\]]*\])", 1)).otherwise(
            F.regexp_extract(authority, r"\A([^:]*)", 1)
        )
    )
    port_text = F.when(
        bracketed, F.regexp_extract(authority, r"(?s)\A\[[^\]]*\]:(.*)\z", 1)
    ).otherwise(F.regexp_extract(authority, r"(?s)\A[^:]*:(.*)\z", 1))
    explicit = F.when(port_text.rlike(r"\A[0-9]+\z"), _port(port_text))
    default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80)).cast("bigint")
    port = F.when(port_text != "", explicit).otherwise(default)
    base_path = F.when(tail.rlike(r"(?s)\A/+\z"), F.lit("/")).otherwise(
        F.regexp_replace(tail, r"/+\z", "")
    )
    error = (
        F.when(c.isNull() | (c == ""), "registry URL is empty")
        .when(F.contains(c, F.lit("#")), "registry URL fragments are rejected")
        .when(sep == 0, "registry URL requires a scheme")
        .when(~scheme.isin("http", "https"), "unsupported registry URL scheme")
        .when(authority == "", "registry URL host is empty")
        .when(F.contains(authority, F.lit("@")), "embedded registry URL credentials are rejected")
        .when(bracketed & ~F.contains(authority, F.lit("]")), "invalid bracketed registry host")
        .when(bracketed & ~authority.rlike(r"(?s)\A\[[^\]]*\](?::.*)?\z"), "invalid registry URL authority")
        .when(~bracketed & (colons > 1), "IPv6 registry hosts require brackets")
        .when(host == "", "registry URL host is empty")
        .when(
            F.endswith(authority, F.lit(":")) | ~F.coalesce(port.between(1, 65535), F.lit(False)),
            "invalid registry URL port",
        )
        .when(
            (scheme == "http") & ~host.isin(*LOOPBACK_HOSTS),
            "plain HTTP is allowed only for explicit local hosts",
        )
        .when(F.contains(tail, F.lit("?")), "registry base URL query is not supported")
    )
    shown_port = F.when(port != default, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit(""))
    normalized = F.concat(scheme, F.lit("://"), host, shown_port, base_path)
    ok = error.isNull()
    return F.struct(
        F.when(ok, scheme).alias("scheme"),
        F.when(ok, host).alias("host"),
        F.when(ok, port.cast("int")).alias("port"),
        F.when(ok, base_path).alias("base_path"),
        F.when(ok, normalized).alias("normalized"),
        error.alias("error"),
    )


def api_url(base: Column | str, cursor: Column | str, updated_since: Column | str) -> Column:
    """List request URL below a normalized base; absent parameters are left out."""
    since, cur = col(updated_since), col(cursor)
    since_part = F.when(since.isNotNull(), F.concat(F.lit("updated_since="), percent_encode(since)))
    cursor_part = F.when(cur.isNotNull(), F.concat(F.lit("cursor="), percent_encode(cur)))
    query = F.concat_ws("&", since_part, cursor_part)
    return F.concat(
        col(base), F.lit(API_PATH), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    )


def valid_download_url(url: Column | str) -> Column:
    """HTTPS, or HTTP to a loopback host with a port, without credentials or fragment."""
    c = col(url)
    secure = F.startswith(c, F.lit("https://")) & (F.length(c) > 8)
    loopback = F.startswith(c, F.lit("http://127.0.0.1:")) | F.startswith(c, F.lit("http://localhost:"))
    authority = F.regexp_extract(c, r"(?s)\Ahttps?://([^/]*)", 1)
    return (
        (secure | loopback)
        & ~F.contains(c, F.lit("#"))
        & (authority != "")
        & ~F.contains(authority, F.lit("@"))
    )
