"""From pages, texts and feeds to candidate releases, as expressions over page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import collapse_whitespace, truncate_excerpt
from ..functions.versions import normalize_version

STRIPPED = ("script", "style", "noscript", "iframe", "svg", "template")
#: Candidates of one page, entries and bytes of one feed; what is over is reported.
MAX_CANDIDATES, MAX_ENTRIES, MAX_FEED_BYTES = 500, 5_000, 4 * 1024 * 1024
# The character references that pages use, apart from numeric ones.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def visible(html: Column) -> Column:
    """Markup without comments and the elements that never show."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in STRIPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def text_of(markup: Column) -> Column:
    out = F.regexp_replace(markup, "(?s)<[^>]*>", " ")
    for name, char in REFERENCES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse_whitespace(out)


def normalize_pages(artifacts: DataFrame, section: str | None = None) -> DataFrame:
    """Visible text and its hash; of one element if ``section`` names a tag. ``error`` says
    that the section is missing, and then there is no text."""
    html = visible(F.col("body"))
    if section:
        found = F.regexp_extract_all(html, F.lit(rf"(?is)<{section}\b[^>]*>(.*?)</{section}\s*>"), 1)
        body = F.when(F.size(found) > 0, F.array_join(F.transform(found, text_of), "\n"))
    else:
        body = text_of(html)
    out = artifacts.withColumn("normalized", body)
    return out.withColumns({"section_hash": F.sha2("normalized", 256), "error": F.when(F.col("normalized").isNull(), "section not found")})


def change_detection(log: DataFrame, key: str = "source_id") -> DataFrame:
    """changed, unchanged or first for each page fetched; an equal section outweighs a changed body."""
    w = Window.partitionBy(key).orderBy("fetched_at", "id")
    before, body = F.lag("section_hash").over(w), F.lag("body_hash").over(w)
    same = F.coalesce(before == F.col("section_hash"), body == F.col("body_hash"))
    rows = log.withColumns({"seen": F.row_number().over(w), "same": same})
    return rows.withColumn("change", F.when(F.col("seen") == 1, "first").when(F.col("same"), "unchanged").otherwise("changed"))


def containers(artifacts: DataFrame, pattern: str, section: str | None = None, limit: int = MAX_CANDIDATES) -> DataFrame:
    """One row per match of ``pattern`` (its first group) in the visible markup, numbered in page
    order; of all elements of the page that ``section`` names, if it does. ``found`` is the number
    of matches, of which the first ``limit`` are rows."""
    found = matches = lambda markup: F.regexp_extract_all(markup, F.lit(pattern), 1)
    if section:
        sections = lambda html: F.regexp_extract_all(html, F.lit(rf"(?is)<{section}\b[^>]*>(.*?)</{section}\s*>"), 1)
        found = lambda html: F.flatten(F.transform(sections(html), matches))
    all_of = artifacts.select("id", found(visible(F.col("body"))).alias("all"))
    return all_of.select("id", F.size("all").alias("found"), F.posexplode(F.slice("all", 1, limit)).alias("container", "markup"))


def field(column: Column, steps: list[tuple]) -> Column:
    """A chain of steps: trim, lower, upper, strip chars, regex_extract pattern, regex_replace
    pattern with, map table. A value that a map does not have is null."""
    for name, *args in steps:
        if name == "trim":
            column = F.trim(column)
        elif name == "lower":
            column = F.lower(column)
        elif name == "upper":
            column = F.upper(column)
        elif name == "strip":
            column = F.translate(column, args[0], "")
        elif name == "regex_extract":
            column = F.nullif(F.regexp_extract(column, args[0], 1), F.lit(""))
        elif name == "regex_replace":
            column = F.regexp_replace(column, args[0], args[1])
        elif name == "map":
            column = F.create_map(*[F.lit(x) for kv in args[0].items() for x in kv])[column]
        else:
            raise ValueError(f"unknown step {name}")
    return column


def build_candidates(rows: DataFrame, fields: dict[str, Column], optional: list[str], layout: str, base: float = 0.95, penalty: float = 0.1, floor: float = 0.5) -> DataFrame:
    """Candidates with confidence and warnings; ``skipped`` where a required field is missing.

    ``fields`` must have version, and may have date (unparsed dates are unknown) and others.
    Every optional field or date without a value costs ``penalty``, down to ``floor``.
    """
    out = rows.withColumns(fields)
    missing = {n: F.coalesce(F.trim(F.col(n)) == "", F.lit(True)) for n in fields}
    required = [n for n in fields if n not in optional and n != "date"]
    warn = [F.when(missing[n], F.lit(f"{n}: no value; candidate skipped")) for n in required]
    warn += [F.when(missing[n], F.lit(f"{n}: no value; confidence lowered")) for n in optional]
    absent = sum((missing[n].cast("int") for n in optional), F.lit(0))
    if "date" in fields:
        parsed = dates.parse_with_layout(F.col("date"), layout)
        out = out.withColumns({"release_date": parsed["anchor"], "release_date_precision": parsed["precision"]})
        undated = F.col("release_date").isNull()
        warn.append(F.when(undated, F.lit("date: no value; release date recorded as unknown")))
        absent = absent + undated.cast("int")
    skipped = missing[required[0]]
    for n in required[1:]:
        skipped = skipped | missing[n]
    return out.withColumns({
        "normalized_version": normalize_version(F.col("version")), "skipped": skipped,
        "warnings": F.array_compact(F.array(*warn)), "confidence": F.round(F.greatest(F.lit(floor), F.lit(base) - absent * penalty), 4),
    })


def evidence(candidates: DataFrame, excerpt: Column) -> DataFrame:
    return candidates.where("not skipped").withColumn("excerpt", truncate_excerpt(excerpt))


def limited(candidates: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` of each ``key``, with ``produced``, how many there were."""
    w = Window.partitionBy(key)
    rows = candidates.withColumns({"nth": F.row_number().over(w.orderBy(*order)), "produced": F.count("*").over(w)})
    return rows.where(F.col("nth") <= most)


ENTRY = "struct<title:string,link:string,description:string,guid:string,pubDate:string>"


ATOM = "struct<title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,id:string,published:string,updated:string>"
# possessive: much white space would otherwise take the stack of the JVM
ROOT = r"(?s)^\x{FEFF}?(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*+(?:\[.*?\])?[^>]*+>)*+<([A-Za-z_][\w.:-]*)"


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of RSS and Atom documents (id, xml); guid falls back to link, and Atom's published
    to updated. ``error`` rows have no entries: no document, one of more than 4 MiB, neither
    dialect, or nothing that could be read. ``warning`` says that later entries are ignored."""
    size, root = F.octet_length("xml"), F.regexp_extract("xml", ROOT, 1)
    rows = feeds.withColumn("root", F.when(size <= MAX_FEED_BYTES, root))
    document = lambda name: F.when(F.col("root") == name, F.col("xml"))
    rss = F.from_xml(document("rss"), f"channel struct<item:array<{ENTRY}>>", {"rowTag": "rss"})["channel"]["item"]
    atom = F.from_xml(document("feed"), f"entry array<{ATOM}>", {"rowTag": "feed"})["entry"]
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    page = lambda e: F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate") & F.coalesce(full(x["_href"]), full(x["_VALUE"])).isNotNull())
    of_rss = lambda e: F.struct(
        F.trim(e["title"]).alias("title"), F.coalesce(full(e["guid"]), F.trim(e["link"])).alias("guid"),
        F.to_date(F.try_to_timestamp(e["pubDate"], F.lit("dd MMM yyyy HH:mm:ss Z"))).alias("published"),
    )
    of_atom = lambda e: F.struct(
        F.trim(e["title"]).alias("title"),
        F.coalesce(full(e["id"]), F.get(F.transform(page(e), lambda x: F.coalesce(full(x["_href"]), full(x["_VALUE"]))), F.lit(0))).alias("guid"),
        F.to_date(F.try_to_timestamp(F.coalesce(full(e["published"]), full(e["updated"])))).alias("published"),
    )
    rows = rows.withColumn("all", F.coalesce(F.transform(rss, of_rss), F.transform(atom, of_atom)))
    n = F.coalesce(F.size("all"), F.lit(0))
    error = (
        F.when(F.col("xml").isNull(), "no document").when(size > MAX_FEED_BYTES, f"more than {MAX_FEED_BYTES} bytes")
        .when(~F.col("root").isin("rss", "feed"), "neither an RSS nor an Atom document").when(n < 1, "no entries could be read")
    )
    warning = F.when(n > MAX_ENTRIES, F.concat(n.cast("string"), F.lit(f" entries, more than {MAX_ENTRIES}; later ones ignored")))
    rows = rows.select("id", error.alias("error"), warning.alias("warning"), F.posexplode_outer(F.slice("all", 1, MAX_ENTRIES)).alias("entry", "e"))
    return rows.select("id", "error", "warning", "entry", "e.title", "e.guid", "e.published")


def robots_audit(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Whether each url (host, path) may be fetched by rules (host, agent, allow, pattern).

    The group of the longest agent that begins ours, or ``*``; in it the longest pattern that
    matches, where an allow wins a tie. ``*`` is any run, a final ``$`` the end.
    """
    ours = robots.where((F.col("agent") == "*") | F.startswith(F.lit(agent), F.col("agent")))
    best = ours.groupBy("host").agg(F.max(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("best"))
    group = ours.join(best, "host").where(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")) == F.col("best"))
    plain = F.regexp_replace("pattern", r"([\\.\[\]{}()+?^|])", r"\\$1")
    ended = F.col("pattern").endswith("$")
    body = F.regexp_replace(F.regexp_replace(plain, r"\$$", ""), r"\*", ".*")
    rules = group.select("host", "allow", F.length("pattern").alias("size"), F.concat(F.lit("(?s)^"), body, F.when(ended, "$").otherwise("")).alias("regex"))
    hits = urls.join(rules, "host", "left").withColumn("fits", F.coalesce(F.regexp_like("path", F.col("regex")), F.lit(False)))
    top = hits.groupBy(*urls.columns).agg(F.max(F.when(F.col("fits"), F.struct("size", "allow"))).alias("rule"))
    return top.withColumn("allowed", F.coalesce(F.col("rule.allow"), F.lit(True))).drop("rule")
