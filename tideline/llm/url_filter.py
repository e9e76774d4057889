"""URL filters with redirect equivalence.

Edges join a page's address to what it redirects to (meta refresh), to its declared canonical link, and to its own
canonical form. Markup is read as a browser reads it: tags in comments, scripts and quoted attributes don't count, an attribute is known by its
whole name, entities are decoded and links are resolved against the page's base. Distributed connected components over them make aliases. A page with a rule of its own has that
rule's verdict. Addresses that pages only name are judged by the rules as well. Any other page is blocked if an alias is blocked by a rule and no alias is explicitly allowed: an
explicit allow takes precedence; without either it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, connected_components, cut, let

#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: White space of markup; elements whose content is text; the named entities that stand for characters of addresses.
SPACE = r" \t\n\f\r"
TEXT_ELEMENTS = ["iframe", "noembed", "noframes", "script", "style", "textarea", "title", "xmp"]
ENTITIES = {"amp": "&", "apos": "'", "colon": ":", "equals": "=", "gt": ">", "lt": "<", "num": "#", "period": ".", "quest": "?", "quot": '"', "sol": "/"}
#: To the end of a tag: a quote counts after = only. All repetitions are possessive, so that hostile markup costs one pass and no stack.
REST = rf"""(?:=[{SPACE}]*+"[^"]*+"|=[{SPACE}]*+'[^']*+'|[^>])*+"""
#: Comments and text elements as a whole, and start tags; what is not closed goes to the end.
MARKUP = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<({'|'.join(TEXT_ELEMENTS)})(?:[{SPACE}/]{REST})?>.*?(?:</\1[{SPACE}/>]|\z)|<[a-z]{REST}(?:>|\z)"
ATTRIBUTE = rf"""(?s)[^{SPACE}/>=]++(?:[{SPACE}]*+=[{SPACE}]*+(?:"[^"]*+"|'[^']*+'|[^{SPACE}>]*+))?"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    rest = F.when(at > 0, rest).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def address(url: Column) -> Column:
    """The node of a url: host and path and query, without scheme and fragment; null where there is no host."""
    host, _ = host_path(url)
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, rest))


def canonical_address(url: Column) -> Column:
    """Without www. and m., fragment, .html and a final slash; the query stays, as it may tell pages apart."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]+)", 1)
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", ""), query))


def tags(html: Column) -> Column:
    """The link, meta and base tags of a page, without those in comments, text elements and attributes."""
    any_ = html.rlike(r"(?i)<(?:link|meta)")
    found = F.filter(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0)), lambda x: x.rlike(rf"(?i)^<(?:link|meta|base)[{SPACE}/]") & x.endswith(">"))
    return F.when(any_, found).otherwise(F.array().cast("array<string>"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, entities decoded; null where it has none."""
    held = F.regexp_extract_all(F.regexp_replace(tag, r"^<[A-Za-z]+", ""), F.lit(ATTRIBUTE), F.lit(0))
    mine = F.get(F.filter(held, lambda x: x.rlike(rf"(?i)^{name}[{SPACE}]*(?:=|\z)")), F.lit(0))
    value = lambda x: F.concat(*[F.regexp_extract(x, rf"""(?s)^[^=]*=[{SPACE}]*(?:"([^"]*)"|'([^']*)'|([^"'].*|["'].*))""", i) for i in (1, 2, 3)])
    return let(let(mine, value), decoded)


def decoded(text: Column) -> Column:
    """Numbered entities and those of ENTITIES, decoded once."""
    named = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)])

    def one(x: Column) -> Column:
        number = F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+)", 1)).cast("long")
        character = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(x)
        return F.when(~x.startswith("&") | (x == "&"), x).when(~x.startswith("&#"), F.element_at(named, x)).otherwise(let(number, character))

    parts = F.regexp_extract_all(text, F.lit(rf"&(?:#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|{'|'.join(ENTITIES)});|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def link_of(written: Column) -> Column:
    """A link without spaces and controls around it, and without line breaks and tabs in it."""
    return F.regexp_replace(written, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]+", "")


def target(tag: Column) -> Column:
    """What a canonical link or a refresh names; null for other tags and where none is named."""
    rel = F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), rf"[{SPACE}]+")
    canonical = F.when(F.array_contains(rel, "canonical"), link_of(attribute(tag, "href")))
    later = lambda x: F.concat(*[F.regexp_extract(x, rf"""(?is)^[{SPACE}]*[0-9.]+[{SPACE}]*[;,{SPACE}][;,{SPACE}]*(?:url[{SPACE}]*=[{SPACE}]*)?(?:"([^"]*)|'([^']*)|([^"'].*))""", i) for i in (1, 2, 3)])
    refresh = F.when(F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh", link_of(let(attribute(tag, "content"), later)))
    return F.when(tag.rlike("(?i)^<link"), canonical).when(tag.rlike("(?i)^<meta"), refresh)


def base_of(page_tags: Column, url: Column) -> Column:
    """The url against which a page's links are resolved: its first base with a target, else its own."""
    written = F.get(F.filter(F.transform(F.filter(page_tags, lambda x: x.rlike("(?i)^<base")), lambda x: attribute(x, "href")), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(let(link_of(written), lambda x: resolve(x, url)), url)


def without_dots(path: Column) -> Column:
    """A path in which . goes, and .. takes the name before it along."""
    parts = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    step = lambda a, x: F.when(x == ".", a).when((x == "..") & (F.size(a) > 1), F.slice(a, 1, F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute url, by the url of the page that it stands on (RFC 3986); null for empty links and schemes without an authority."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    path, query = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    here = F.concat(scheme, F.lit("://"), host)
    full = (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("#"), F.concat(here, query))
        .when(link.startswith("?"), F.concat(here, path, link))
        .when(link.startswith("/"), F.concat(here, link))
        .otherwise(F.concat(here, folder, link))
    )
    part = lambda x, i: F.regexp_extract(x, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", i)
    return let(full, lambda x: F.when(part(x, 2).contains("/."), F.concat(part(x, 1), without_dots(part(x, 2)), part(x, 3))).otherwise(x))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits: longest host, then longest path; at equal length block comes first."""
    for verdict, h, p in rules:
        if verdict not in ("allow", "block") or not p.startswith("/"):
            raise ValueError(f"not a rule: {verdict} {h}{p}")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def edges(pages: DataFrame) -> DataFrame:
    """pages -> (u, v) between addresses."""
    d = pages.select("url", address(F.col("url")).alias("u"), canonical_address(F.col("url")).alias("c"), tags(F.col("html")).alias("tags")).where("u is not null")
    d = d.select("url", "u", "c", "tags", F.filter(F.transform("tags", target), lambda x: F.coalesce(x, F.lit("")) != "").alias("to"))
    d = d.select("u", "c", "to", F.when(F.size("to") > 0, base_of(F.col("tags"), F.col("url"))).alias("base"))
    v = F.concat(F.array("c"), F.transform("to", lambda x: let(resolve(x, F.col("base")), address)))
    return d.select("u", F.explode(v).alias("v")).where("v is not null and u <> v")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict, propagated boolean; one row for each row given.

    A url that is null or has no :// has empty host and path, no rule and is allowed. A null or empty html declares nothing; very long
    ones are read whole, and every tag in them counts; a tag, comment or script that is not closed goes to the end and declares nothing. Repeated rows get equal verdicts. Of rules of equal length block comes first. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("node"))
    rows = rows.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    labels = cut(connected_components(edges(pages)))
    # every address has its rule, whether a page of it is at hand or not
    at = [F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)]
    said = labels.select("label", matching_rule(*at, rules)["verdict"].alias("verdict")).where("verdict is not null")
    said = said.groupBy("label").agg(F.bool_or(F.col("verdict") == "block").alias("blocked"), F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    blocked = labels.join(said.where("blocked and not allowed").select("label"), "label", "left_semi").select(F.col("node").alias("_n"))
    out = rows.join(blocked, rows.node == F.col("_n"), "left")
    passed = F.col("own").isNull() & F.col("_n").isNotNull()
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.when(passed, "block").otherwise("allow")).alias("verdict"), passed.alias("propagated"))
