"""Every catalogue query against its SQL in DuckDB on the same tables."""

import decimal
import math

import duckdb
import pytest

from quayside.operators import gates
from quayside.plans import catalogue
from quayside.plans.bindings import BASE, VIEWS

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 180


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    told = duck.execute(ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ordered(frame.select(columns).collect()) == ordered([[r[i] for i in at] for r in told.fetchall()])


@pytest.mark.parametrize("name", ["extraction_warnings", "extract_collectors", "extraction_limits", "extract_html"])
def test_a_page_of_very_many_paragraphs(spark, tmp_path, name):
    body = "<html><body><article><h1>Many</h1>{}</article></body></html>"
    pages = [(k, f"u{k}", body.format("".join(f"<p>word{j} <b>bold</b></p>" if j % 3 else f"<p>{j}</p>" for j in range(n)))) for k, n in ((2, 700), (4, 500), (5, 700), (8, 0))]
    texts = [(1, "Abcdefghijkl, " * 700, "en", "s", 9800), (2, "none", "en", "s", 4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    told = con.execute(ORACLES[name])
    columns = [d[0] for d in told.description]
    assert ordered(QUERIES[name](spark, str(tmp_path)).select(columns).collect()) == ordered(told.fetchall())


@pytest.mark.parametrize("name", ["cve_correlation", "security_status"])
def test_advisories_meet_the_versions_of_all_releases(spark, sf_dir, duck, name):
    got = {(r.product_id, r.version) for r in QUERIES[name](spark, sf_dir).where("version is not null").select("product_id", "version").distinct().collect()}
    known = duck.execute(f"SELECT DISTINCT m.product_id, r.version FROM ({VIEWS['releases']}) r JOIN ({VIEWS['mappings']}) m ON m.release_id = r.id").fetchall()
    about = {product for product, _ in got}
    assert got and got == {(p, v) for p, v in known if p in about}


def test_a_text_gives_all_its_candidates(spark, tmp_path):
    # over 500 candidates; and one more beyond 4 MiB, which Thursdayish is only once its Th is replaced
    texts = [(1, "Abcdefghijkl, " * 700, "en", "s", 9800), (2, "x " * (1 << 21) + "Abcdefghijkl. " * 600 + "Thursdayish ", "en", "s", 0), (3, "none", "en", "s", 4), (4, None, "en", "s", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    told = con.execute(ORACLES["extract_text"])
    columns = [d[0] for d in told.description]
    got = ordered(QUERIES["extract_text"](spark, str(tmp_path)).select(columns).collect())
    assert got == ordered(told.fetchall()) and len(got) == 700 + 601


def test_the_pivot_of_gates_has_every_gate(spark, sf_dir):
    of = {r.id: r for r in QUERIES["gate_results_pivot"](spark, sf_dir).collect()}
    ran = {r.id: r.gates_run for r in QUERIES["validate_candidates"](spark, sf_dir).collect()}
    assert {k: sum(r[g] is not None for g in gates.GATES) for k, r in of.items()} == ran and {10, 1} <= set(ran.values())
