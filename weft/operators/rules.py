"""Validation rules: each a nullable (tag, msg) column; warnings are those that are not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, urls

MAX_URL = 2047
MAX_DOWNLOAD, MAX_PARSE = 5 << 20, 1 << 20
HTML = ("text/html", "application/xhtml+xml")


def warning(when: Column, tag: str, msg: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(tag).alias("tag"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg")))


def warnings(*rules: Column, ignored: tuple[str, ...] = ()) -> Column:
    """The rules that hold, each once, without the ignored tags."""
    return F.filter(F.array_distinct(F.array_compact(F.array(*rules))), lambda x: ~x.tag.isin(*ignored) if ignored else F.lit(True))


def url_rules(raw: Column, url: Column) -> list[Column]:
    """F2 to F5."""
    effective = urls.normalise(url)
    return [
        warning(raw != F.regexp_replace(raw, r"^\s+|\s+$", ""), "url-whitespace", "Leading or trailing whitespace in URL"),
        warning(effective != url, "url-effective-url", F.concat(F.lit("Effective URL "), effective)),
        warning((F.length(url) > MAX_URL) & ~url.startswith("data:"), "url-too-long", F.concat(F.lit("URL length "), F.length(url), F.lit(f" is longer than {MAX_URL}"))),
        warning(urls.part(url, "scheme").isin("ftp", "http", "telnet") & scalars.is_obfuscated_ip(urls.host(url)), "url-obfuscated-ip", "URL has an obfuscated IP address"),
    ]


def url_error(url: Column) -> Column:
    """Why a URL is invalid, else null."""
    scheme = urls.part(url, "scheme")
    kind = urls.scheme_class(url)
    bad_port = urls.host(url).rlike(":[^:\\]]*$")
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "URL is empty").when(kind == "unknown", "URL is unrecognized")
        .when(scheme.isin("ftp", "http", "telnet") & (urls.host(url) == ""), "URL has empty hostname").when(scheme.isin("ftp", "http", "https") & bad_port, "URL has invalid port")
    )


def size_rules(size: Column, limit: int = MAX_DOWNLOAD) -> list[Column]:
    """F7."""
    return [warning(size > limit, "url-content-too-large", "Content is too large"), warning(size == 0, "url-content-size-zero", "Content size is zero")]


def status_valid(status: Column) -> Column:
    """F8."""
    return status < 400


def status_result(status: Column, reason: Column | None = None) -> Column:
    """F8: code and reason, or OK below 200."""
    text = F.concat_ws(" ", status.cast("string"), F.nullif(reason, F.lit(""))) if reason is not None else status.cast("string")
    return F.when(status >= 200, text).otherwise("OK")


def status_rule(status: Column) -> Column:
    return warning(status == 204, "http-empty-content", "No content")


def recurses(valid: Column, level: Column, extern: Column, size: Column, content_type: Column, follow: Column, max_level: int = -1, max_parse: int = MAX_PARSE) -> Column:
    """Whether a page's links are followed."""
    deep = F.lit(True) if max_level < 0 else level < max_level
    return valid & deep & ~extern & (F.coalesce(size, F.lit(0)) <= max_parse) & scalars.mime(content_type).isin(*HTML, "text/css", "text/plain") & follow


def printed(valid: Column, warned: Column, verbose: bool = False, warn: bool = True) -> Column:
    """F10."""
    return F.lit(verbose) | ~valid | (F.lit(warn) & (F.size(warned) > 0))


def mail_error(mail: Column) -> Column:
    """the first check that an address fails, else null."""
    local, domain = F.regexp_extract(mail, "(?s)^(.*)@[^@]*$", 1), F.regexp_extract(mail, "(?s)@([^@]*)$", 1)
    quoted = local.rlike('(?s)^".*"$') & (F.length(local) > 1)
    inner = F.regexp_replace(F.regexp_replace(local, '(?s)^"|"$', ""), r'\\.', "")
    special = F.lit(False)
    for c in '@ \\",[]':
        special = special | F.replace(local, F.lit(f"\\{c}"), F.lit("")).contains(c)
    literal = domain.rlike(r"^\[.*\]$")
    ip = F.regexp_replace(F.regexp_replace(domain, r"^\[(IPv6:)?", ""), r"\]$", "")
    return (
        F.when(F.length(mail) > 256, "too-long").when(~mail.contains("@"), "no-at").when(local == "", "no-local").when(domain == "", "no-domain")
        .when(F.length(local) > 64, "local-too-long").when(F.length(domain) > 255, "domain-too-long")
        .when(quoted & inner.rlike(r'["\\]'), "quote")
        .when(~quoted & local.startswith("."), "leading-dot").when(~quoted & local.endswith("."), "trailing-dot").when(~quoted & local.contains(".."), "double-dot").when(~quoted & special, "special")
        .when(literal & ~(scalars.is_ipv4(ip) | scalars.is_ipv6(ip)), "ip")
        .when(~literal & ~urls.is_safe(domain, "domain"), "domain").when(~literal & (domain.endswith(".") | domain.rlike(r"(^|\.)[0-9]+$")), "tld")
    )


def empty_mailto(url: Column) -> Column:
    """F14."""
    return warning((F.size(scalars.mail_addresses(url)) == 0) & ~urls.part(url, "query").rlike("(?i)(^|[&;])subject=."), "mail-no-mail-host", "No mail addresses or email subject found")


def itms_error(url: Column) -> Column:
    """F15."""
    return F.when(~urls.part(url, "query").contains("url="), "Missing required url parameter")


def missing_slash(url: Column, is_folder: Column, scheme: str) -> Column:
    """F17."""
    return warning(is_folder & ~url.endswith("/"), f"{scheme}-missing-slash", F.concat(F.lit("Missing trailing slash, "), url, F.lit("/")))


def file_under_web(url: Column, parent: Column) -> Column:
    """F18."""
    return F.when((urls.part(url, "scheme") == "file") & parent.isNotNull() & (urls.part(parent, "scheme") != "file"), "Local files are only checked without parent URL or when the parent URL is also a file.")


def tls_rule(not_after: Column, as_of: Column, days: int = 30) -> Column:
    """F19."""
    end = scalars.tls_time(not_after)
    left = F.unix_timestamp(end) - F.unix_timestamp(as_of)
    return F.coalesce(
        warning(not_after.isNull(), "ssl-certificate-missing-info", "certificate did not include notAfter"),
        warning(left < 0, "ssl-certificate-expired", "certificate is expired"), warning(left < days * 86400, "ssl-certificate-expires", "certificate will expire"),
    )


def header_info(headers: Column, prefixes: tuple[str, ...]) -> Column:
    """Name=value of the headers with one of the prefixes."""
    wanted = F.map_filter(headers, lambda k, v: F.lit(False) if not prefixes else F.reduce(F.array(*[F.lower(k).startswith(p.lower()) for p in prefixes]), F.lit(False), lambda a, x: a | x))
    return F.array_sort(F.transform(F.map_entries(wanted), lambda e: F.concat(e.key, F.lit("="), e.value)))


def with_missing_slash(links: DataFrame, folders: DataFrame, scheme: str) -> DataFrame:
    """links (url) with a warning where a listing's folder (url without the slash) is named without it."""
    known = folders.select("url", F.lit(True).alias("is_folder")).distinct()
    joined = links.join(known, "url", "left")
    return joined.withColumn("warning", missing_slash(F.col("url"), F.coalesce("is_folder", F.lit(False)), scheme)).drop("is_folder")


def news_rules(url: Column) -> list[Column]:
    """F21, of news."""
    nntp = urls.part(url, "scheme").isin("nntp", "news", "snews")
    return [
        warning(nntp & (urls.part(url, "scheme") == "nntp") & (urls.host(url) == ""), "nntp-no-server", "No NNTP server was specified"),
        warning(nntp & (F.regexp_replace(urls.part(url, "path"), "^/", "") == ""), "nntp-no-newsgroup", "No newsgroup specified in NNTP URL"),
    ]


def telnet_error(url: Column) -> Column:
    """F21, of telnet."""
    return F.when((urls.part(url, "scheme") == "telnet") & (urls.host(url) == ""), "Host is empty")
