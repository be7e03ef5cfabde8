"""Addresses, text, sizes and times as column expressions."""

from __future__ import annotations

from email.utils import getaddresses
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .binding import bound, record
from .urls import part, unquote

_V4 = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
_H = "[0-9a-f]{1,4}"
_V6 = [
    rf"({_H}:){{7}}{_H}", rf"({_H}:){{1,7}}:", rf"({_H}:){{1,6}}(:{_H}){{1}}", rf"({_H}:){{1,5}}(:{_H}){{1,2}}", rf"({_H}:){{1,4}}(:{_H}){{1,3}}",
    rf"({_H}:){{1,3}}(:{_H}){{1,4}}", rf"({_H}:){{1,2}}(:{_H}){{1,5}}", rf"{_H}:(:{_H}){{1,6}}", rf":(:{_H}){{1,7}}", "::", rf"::(ffff:)?{_V4}",
]
#: A character entity by name or number.
ENTITY = r"&(?:#[xX]?)?[0-9A-Za-z]+;"
#: The space separators of Unicode (Zs).
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def is_ipv4(text: Column) -> Column:
    """X1."""
    return text.rlike(f"^{_V4}$") & F.coalesce(F.forall(F.split(text, r"\."), lambda x: x.try_cast("int") <= 255), F.lit(False))


def is_ipv6(text: Column) -> Column:
    """Full, short and v4-mapped forms."""
    return text.rlike(f"(?i)^({'|'.join(_V6)})$")


def expand_ipv6(text: Column) -> Column:
    """Eight groups; :: stands for as many groups of 0 as are missing."""
    left, right = (F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(i)), ":"), lambda x: x != "") for i in (1, 2))
    short = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    return F.array_join(F.when(text.contains("::"), short).otherwise(F.split(text, ":")), ":")


def is_obfuscated_ip(name: Column) -> Column:
    """A hexadecimal or a plain number in place of an address."""
    return name.rlike("(?i)^(0x[0-9a-f]+|[0-9]+)$")


def obfuscated_ip(ip: Column) -> Column:
    """The hexadecimal numbers of an IPv4 address, each as short as it is, as one."""
    return F.concat(F.lit("0x"), F.array_join(F.transform(F.split(ip, r"\."), lambda x: F.lower(F.hex(x.cast("int")))), ""))


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number."""
    return F.when(is_ipv4(ip), F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))


def ip_text(number: Column) -> Column:
    """And back."""
    return F.concat_ws(".", *[F.pmod(F.floor(number / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def cidr_mask(bits: Column) -> Column:
    """The mask of a prefix length."""
    return F.lit(0xFFFFFFFF) - (F.pow(F.lit(2), F.lit(32) - bits).cast("long") - 1)


def unquoted(text: Column, matching: bool = False) -> Column:
    """Without one quotation mark at each end, which must be the same if ``matching``."""
    if matching:
        return F.regexp_replace(text, r"""^(['"])(.*)\1$""", "$2")
    return F.regexp_replace(text, r"""^['"]|['"]$""", "")


def without_markup(text: Column) -> Column:
    """X7."""
    return F.regexp_replace(text, "(?s)<.*?>", "")


def _character(number: Column) -> Column:
    """The character of a code point; none if there is no such."""
    fits = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.coalesce(F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), F.lit(""))


def resolved(text: Column) -> Column:
    """Entities by name, decimal or hexadecimal number, once; unknown ones are left out."""
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def one(p: Column) -> Column:
        number = F.when(F.length(p.digits) <= 8, F.when(p.piece.rlike("^&#[xX]"), F.conv(p.digits, 16, 10)).when(p.digits.rlike("^[0-9]+$"), p.digits))
        character = bound(number.cast("long"), _character)
        return F.when(~p.piece.rlike(f"^{ENTITY}$"), p.piece).when(p.piece.startswith("&#"), F.coalesce(character, F.lit(""))).otherwise(
            F.coalesce(F.try_element_at(names, F.substring(p.piece, 2, F.length(p.piece) - 2)), F.lit("")))

    def parts(whole: Column) -> Column:
        pieces = F.regexp_extract_all(whole, F.lit(f"(?s){ENTITY}|[^&]+|&"), F.lit(0))
        with_digits = F.transform(pieces, lambda x: record(piece=x, digits=F.regexp_extract(x, "^&#[xX]?([0-9A-Fa-f]+);$", 1)))
        return F.when(whole.contains("&"), F.array_join(F.transform(with_digits, one), "")).otherwise(whole)

    return bound(text, parts)


def without_comments(text: Column) -> Column:
    """X9."""
    return F.regexp_replace(text, r"(?s)/\*.*?\*/", "")


def without_controls(text: Column) -> Column:
    """X10."""
    return F.regexp_replace(text, r"[\x01-\x1F\x7F]", "")


def limited(text: Column, n: int) -> Column:
    """X11."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def human_size(size: Column, largest: str = "GB") -> Column:
    """Whole bytes, and whole KB below 10 KB; then two decimals up to 10 of a unit (KB: 1024), and one above; MB or GB is the largest unit."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    part = lambda unit, digits, name: F.concat(F.format_string(f"%.{digits}f", F.bround(size / unit, digits)), F.lit(name))  # noqa: E731  half to even
    text = (
        F.when(size < kb, F.concat(size, F.lit("B"))).when(size < 10 * kb, F.concat(F.floor(size / kb), F.lit("KB"))).when(size < mb, part(kb, 2, "KB"))
        .when(size < 10 * mb, part(mb, 2, "MB"))
    )
    # format_string writes a null as a word, so none gets there
    if largest == "MB":
        return text.when(size.isNotNull(), part(mb, 1, "MB"))
    return text.when(size < gb, part(mb, 1, "MB")).when(size < F.lit(10).cast("long") * gb, part(gb, 2, "GB")).when(size.isNotNull(), part(gb, 1, "GB"))


def human_duration(seconds: Column) -> Column:
    """Minutes and seconds, rounded up, with hours before them if there are any, and a sign."""
    s = F.ceil(F.abs(seconds))
    h, m = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60))
    text = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, F.pmod(s, F.lit(60)))).when(h == 0, F.format_string("%02d:%02d", m, F.pmod(s, F.lit(60))))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)


def long_duration(seconds: Column) -> Column:
    """Years, days, hours, minutes and seconds; of more than two parts the smallest goes; hundredths below one second."""
    whole, units = F.floor(F.abs(seconds)), []
    for name, size, of in (("year", 31_536_000, None), ("day", 86_400, 365), ("hour", 3600, 24), ("minute", 60, 60), ("second", 1, 60)):
        n = F.floor(whole / size)
        n = n if of is None else F.pmod(n, F.lit(of))
        units.append(F.when(n > 0, F.concat(n, F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))))
    found = F.array_compact(F.array(*units))
    # of more than two parts, the smallest is left out
    text = F.array_join(F.when(F.size(found) > 2, F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found), ", ")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.when(F.abs(seconds) < 1, F.concat(F.format_string("%.2f", F.abs(seconds)), F.lit(" seconds"))).otherwise(text))


def first_line(text: Column) -> Column:
    """Without the blanks of any width at its ends."""
    return F.btrim(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(BLANKS))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a place given from 0."""
    before = F.left(text, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def mime(content_type: Column) -> Column:
    """X16."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("application/octet-stream"))


def charset(content_type: Column) -> Column:
    """E14, of a header."""
    return F.nullif(F.regexp_extract(F.lower(content_type), "charset=([-0-9a-z]+)", 1), F.lit(""))


def graph_label(text: Column) -> Column:
    """X17."""
    return F.trim(F.regexp_replace(text, r"[^-A-Za-z0-9_.,:/ ]", " "))


def xml_escaped(text: Column) -> Column:
    """X18."""
    for c, entity in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}.items():
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def sql_quoted(text: Column) -> Column:
    """In quotation marks, with those within doubled; null for null."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(text: Column) -> Column:
    """Null if empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", "NULL").otherwise(sql_quoted(text))


def modified(time: Column, separator: str = " ") -> Column:
    """X20."""
    return F.date_format(time, f"yyyy-MM-dd'{separator}'HH:mm:ss.SSSSSS'Z'")


def tls_time(text: Column) -> Column:
    """ASN.1, in UTC or with an offset, or notAfter text, in UTC."""
    asn1 = F.regexp_extract(text, "^([0-9]{14})(Z|[-+][0-9]{4})?$", 1)
    offset = F.regexp_extract(text, "^[0-9]{14}([-+][0-9]{4})$", 1)
    away = F.coalesce((F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 4, 2).try_cast("int") * 60) * F.when(offset.startswith("-"), -1).otherwise(1), F.lit(0))
    at = F.unix_timestamp(F.try_to_timestamp(asn1, F.lit("yyyyMMddHHmmss"))) - away
    named = F.regexp_replace(F.regexp_replace(text, " +GMT$", ""), " +", " ")
    return F.coalesce(F.timestamp_seconds(at), F.try_to_timestamp(named, F.lit("MMM d HH:mm:ss yyyy")))


@F.arrow_udf(ArrayType(StringType()))
def _listed(texts: pa.Array) -> pa.Array:
    """The addresses of lists with groups, comments or quoted marks; null for null."""
    out = []
    for text in texts.to_pylist():
        out.append(None if text is None else [a.strip() for _, a in getaddresses([text], strict=False) if a.strip()])
    return pa.array(out, pa.list_(pa.string()))


def with_mail_addresses(rows: DataFrame, url: str, name: str = "addresses") -> DataFrame:
    """Rows with the addresses of a column of mailto URLs, sorted and each once.

    Lists with the marks of groups, comments or quoted pairs go through a lexer
    of mail headers in batches; for all others the lexer sees nulls only.
    """
    lists = _mail_lists(F.col(url))
    hard = F.exists(lists, lambda x: x.rlike(r"[():;\\]"))
    lexed = rows.withColumn("_lexed", _listed(F.when(hard, F.array_join(lists, ","))))
    return lexed.withColumn(name, F.coalesce(F.array_sort(F.array_distinct("_lexed")), mail_addresses(F.col(url)))).drop("_lexed")


def _mail_lists(url: Column) -> Column:
    """The lists of addresses in a mailto URL: its path and its to, cc and bcc."""
    path = F.regexp_extract(url, "(?i)^mailto:([^?#]*)", 1)
    more = F.transform(F.filter(F.split(part(url, "query"), "[&;]"), lambda x: x.rlike("(?i)^(to|cc|bcc)=")), lambda x: F.regexp_replace(x, "^[^=]*=", ""))
    return F.filter(F.transform(F.concat(F.array(path), more), unquote), lambda x: x != "")


def mail_addresses(url: Column) -> Column:
    """Of a mailto URL: its path and its to, cc and bcc; a comma within quotation marks does not part addresses."""
    every = F.flatten(F.transform(_mail_lists(url), lambda x: F.regexp_extract_all(x, F.lit(r'(?:"[^"]*"|[^,"]|")+'), F.lit(0))))
    bare = F.transform(every, lambda x: F.when(x.rlike("<[^>]+>"), F.regexp_extract(x, "<([^>]+)>", 1)).otherwise(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != "")))
