"""Candidates from artifacts by collectors' configurations, with all that went wrong in the same pass.

A configuration is a row: collector_id, and ``spec``, a JSON object of

- ``engine``: ``text_regex``, whose ``container`` is a pattern with named groups, or
  ``html_selectors``, whose ``container``, ``section`` and ``strip`` are CSS selectors;
- ``replace``: patterns and what to put in their place before a text is matched;
- ``fields``: by name, the ``group`` of the match (the name itself if not said), or ``selector``,
  ``attribute`` and ``first``, or a literal ``value``; ``transforms``; ``required``; and for dates
  ``date_format`` (strptime's, or ``epoch_seconds``) and ``precision``;
- ``channel``, ``release_type``, ``product``: what holds for all candidates;
- ``max_bytes``, ``max_candidates``, and ``base``, ``penalty`` and ``floor`` of the confidence;
- ``whole``: a text is matched from end to end and all its candidates are kept, so its pattern must not backtrack.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_excerpt
from ..functions.versions import dedupe_key, normalize_version
from .extract import MAX_CANDIDATES
from .selectors import Field, _Reader, compile_selector, shown

#: A text is matched up to this, whatever its configuration says unless ``whole``; a page over its own limit is not read.
MAX_TEXT_BYTES, MAX_PAGE_BYTES = 4 * 1024 * 1024, 2 * 1024 * 1024
#: A pattern that backtracks for so many seconds is given up.
SECONDS = 15.0
DATES = ("release_date", "publication_date")
ANCHORS = {"exact_day": "%Y-%m-%d", "month_only": "%Y-%m-01", "year_only": "%Y-01-01"}


def transform(value: str | None, steps: list) -> str | None:
    """A value after each step: trim, lowercase, uppercase, strip_prefix x, strip_suffix x, regex_extract
    pattern, regex_replace pattern with, map table. What a step does not find is null."""
    for name, *args in (s if isinstance(s, list) else [s] for s in steps):
        if value is None:
            return None
        if name == "trim":
            value = value.strip()
        elif name == "lowercase":
            value = value.lower()
        elif name == "uppercase":
            value = value.upper()
        elif name == "strip_prefix":
            value = value.removeprefix(args[0])
        elif name == "strip_suffix":
            value = value.removesuffix(args[0])
        elif name == "regex_extract":
            found = regex.search(args[0], value, timeout=SECONDS)
            value = found and (found.group(1) if found.re.groups else found.group())
        elif name == "regex_replace":
            value = regex.sub(args[0], args[1], value, timeout=SECONDS)
        elif name == "map":
            value = args[0].get(value)
        else:
            raise ValueError(f"unknown transform {name!r}")
    return value


def _date(value: str, layout: str, precision: str) -> str | None:
    """The first day of the period that a text names, or None if it is not as ``layout`` says."""
    try:
        if layout == "epoch_seconds":
            when = datetime.fromtimestamp(int(value), timezone.utc)
        else:
            when = datetime.strptime(value, layout)
        return when.strftime(ANCHORS[precision]) if 1970 <= when.year <= 2200 else None
    except (ValueError, OverflowError, OSError):
        return None


class Collector:
    """One configuration, compiled. ``read`` gives the candidates and the warnings of an artifact."""

    def __init__(self, spec: dict):
        self.spec, self.fields = spec, spec.get("fields", {})
        self.whole = spec.get("whole", False)
        self.most = None if self.whole else spec.get("max_candidates", MAX_CANDIDATES)
        if "version" not in self.fields:
            raise ValueError("no field says the version")
        if self.whole and (spec["engine"] != "text_regex" or "max_bytes" in spec or "max_candidates" in spec):
            raise ValueError("only a text without limits is matched whole")
        if spec["engine"] == "text_regex":
            self.pattern, self.find = regex.compile(spec["container"]), self._matches
        elif spec["engine"] == "html_selectors":
            at = lambda f: (Field(f.get("selector"), f.get("attribute"), f.get("first", False)), compile_selector(f["selector"]) if f.get("selector") else None)
            self.specs = {n: at(f) for n, f in self.fields.items() if "value" not in f}
            self.parts = [compile_selector(s) for s in spec.get("strip", [])], compile_selector(spec["section"]) if spec.get("section") else None, compile_selector(spec["container"])
            self.find = self._elements
        else:
            raise ValueError(f"unknown engine {spec['engine']!r}")

    def _matches(self, body: str, warn: Callable) -> Iterator[tuple[str, dict, list]]:
        limit, data = min(self.spec.get("max_bytes", MAX_TEXT_BYTES), MAX_TEXT_BYTES), body.encode()
        if len(data) > limit and not self.whole:
            warn("truncated", f"{len(data)} bytes, of which {limit} are matched")
            body = data[:limit].decode(errors="ignore")
        for pattern, put in self.spec.get("replace", []):
            # of linear time, whatever the pattern
            body = pc.replace_substring_regex(pa.scalar(body), pattern, put).as_py()
        for m in self.pattern.finditer(body, timeout=None if self.whole else SECONDS):
            named = m.groupdict()
            yield m.group(), {n: named.get(f.get("group", n)) for n, f in self.fields.items() if "value" not in f}, []

    def _elements(self, body: str, warn: Callable) -> Iterator[tuple[str, dict, list]]:
        limit = self.spec.get("max_bytes", MAX_PAGE_BYTES)
        if len(body.encode()) > limit:
            warn("too_large", f"more than {limit} bytes; the page is not read")
            return
        reader = _Reader(*self.parts, self.specs)
        reader.feed(body)
        reader.close()
        for box in reader.done:
            values, many = {}, []
            for name, (spec, _) in self.specs.items():
                found = box.found.get(name, [])
                if len(found) > 1 and not spec.first:
                    many.append((name, len(found)))
                    found = []
                values[name] = None if not found else found[0][0] if spec.attribute else shown(found[0][1])
            yield shown(box.text), values, many

    def read(self, body: str) -> tuple[list[tuple], list[tuple]]:
        """Rows (container, found, values, anchor, precision, confidence, excerpt) and (container, warning, detail)."""
        rows, told, n = [], [], 0
        warn = lambda kind, detail, container=None: told.append((container, kind, detail))
        try:
            for n, (text, values, many) in enumerate(self.find(body, warn), 1):
                if (self.most is None or n <= self.most) and (made := self._candidate(n - 1, text, values, many, warn)):
                    rows.append(made)
        except TimeoutError:
            warn("timeout", f"a pattern took more than {SECONDS:g} seconds; later candidates are lost")
        if not n and not told:
            warn("no_match", "the container matched nothing")
        if self.most is not None and n > self.most:
            warn("too_many", f"{n} candidates, of which the first {self.most} are kept")
        return [(r[0], n, *r[1:]) for r in rows], told

    def _candidate(self, k: int, text: str, raw: dict, many: list, warn: Callable) -> tuple | None:
        values, missing = {}, 0
        for name, count in many:
            warn("ambiguous", f"{name}: {count} elements", k)
        for name, f in self.fields.items():
            value = transform(f.get("value", raw.get(name)), f.get("transforms", []))
            values[name] = value if value and value.strip() else None
            if values[name] is None and name not in DATES:
                if name == "version" or f.get("required", False):
                    warn("skipped", f"{name} has no value", k)
                    return None
                warn("lowered", f"{name} has no value", k)
                missing += 1
        anchor, precision = None, "unknown"
        if date := self.fields.get("release_date"):
            said = values.pop("release_date")
            anchor = _date(said.strip(), date["date_format"], date["precision"]) if said else None
            precision = date["precision"] if anchor else "unknown"
            if anchor is None:
                warn("undated", "release_date has no value" if said is None else f"release_date: {said[:80]!r} is not {date['date_format']}", k)
                missing += 1
        for name in ("channel", "release_type"):
            values.setdefault(name, self.spec.get(name))
        values["product_hint"] = values.get("product_hint") or self.spec.get("product")
        s = self.spec
        confidence = round(max(s.get("floor", 0.5), s.get("base", 0.95) - missing * s.get("penalty", 0.1)), 4)
        return k, list(values.items()), anchor, precision, confidence, text


SCHEMA = (
    "collector_id string, container int, found int, fields map<string,string>, release_date date, release_date_precision string, "
    "confidence double, excerpt string, warning string, detail string"
)


def extract(artifacts: DataFrame, configs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates and warnings of every artifact (id, collector_id, body, and the columns to ``keep``).

    A row is a candidate, with container, found (how many the artifact has), fields, release_date,
    release_date_precision, confidence and excerpt; or a warning, with ``warning`` and ``detail``,
    about one container or the artifact: no_config, bad_config, no_match, truncated, too_large,
    too_many, timeout, skipped, lowered, undated or ambiguous. ``candidates`` and ``warnings`` are
    the two parts. Artifacts are dealt evenly by id, however many one collector has; configurations,
    a short row each, go to every task, which compiles each that it meets once. A null body is empty.
    """
    told = artifacts.repartition("id").join(F.broadcast(configs.select("collector_id", "spec")), "collector_id", "left")
    names = ["id", *keep]

    def rows_of(spec: str | None, body: str | None, known: dict) -> tuple[list, list]:
        if spec is None:
            return [], [(None, "no_config", "no configuration has this collector")]
        if spec not in known:
            try:
                known[spec] = Collector(json.loads(spec))
            except (ValueError, KeyError, TypeError, regex.error) as e:
                known[spec] = f"{type(e).__name__}: {e}"
        if isinstance(known[spec], str):
            return [], [(None, "bad_config", known[spec])]
        return known[spec].read(body or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kinds = [pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            at, out, size = [], [], 0
            for k in range(batch.num_rows):
                rows, warned = rows_of(batch.column("spec")[k].as_py(), batch.column("body")[k].as_py(), known)
                out += [(*r, None, None) for r in rows]
                out += [(c, None, None, None, None, None, None, w, d) for c, w, d in warned]
                at += [k] * (len(rows) + len(warned))
                size += sum(len(r[-1]) for r in rows)
                if out and (k + 1 == batch.num_rows or size > 4_000_000):
                    head = batch.select([*names, "collector_id"]).take(pa.array(at))
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    cols[3] = cols[3].cast(pa.date32())
                    yield pa.RecordBatch.from_arrays([*head.columns, *cols], [*names, *(x.split(" ")[0] for x in SCHEMA.split(", "))])
                    at, out, size = [], [], 0

    schema = ", ".join(f"{n} {artifacts.schema[n].dataType.simpleString()}" for n in names) + ", " + SCHEMA
    return told.select(*names, "collector_id", "spec", F.col("body").cast("string")).mapInArrow(run, schema)


def candidates(extracted: DataFrame) -> DataFrame:
    """The candidates of what ``extract`` gives, with versions, keys and bounded excerpts."""
    f = lambda name: F.col("fields")[name]
    none = F.lit("")
    version = normalize_version(F.coalesce(f("normalized_version"), f("version")))
    rows = extracted.where("warning is null").drop("warning", "detail").withColumns({"raw_version": f("version"), "version": version, "channel": f("channel"), "hint": f("product_hint"), "release_type": f("release_type")})
    key = dedupe_key(F.col("hint"), F.col("version"), F.col("channel"), *(F.coalesce(f(n), none) for n in ("hardware_revision", "region", "deployment_mode")))
    return rows.withColumns({"dedupe_key": key, "excerpt": truncate_excerpt(F.col("excerpt"))})


def warnings(extracted: DataFrame) -> DataFrame:
    return extracted.where("warning is not null").select("id", "collector_id", "container", "warning", "detail")
