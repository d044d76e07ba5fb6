"""Domain tables over the star-schema, event and text tables.

Each table is one SELECT in SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
Sources are registered lazily as temporary views of Parquet files; column pruning and filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Domain table -> (source tables or domain tables, SELECT).
VIEWS = {
    "party": (
        ("supplier", "nation"),
        """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, n_name AS region, s_suppkey % 4 <> 0 AS profile_public, 51 + s_suppkey % 50 AS ownership_pct,
        CASE s_suppkey % 3 WHEN 0 THEN 'nation_certified' WHEN 1 THEN 'ccib_certified' ELSE 'self_declared' END AS tier,
        CASE WHEN s_suppkey % 3 = 2 THEN 'pending' ELSE 'verified' END AS verification, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1999-12-31' END AS expires_on,
        CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'automobile' WHEN 2 THEN 'machinery' WHEN 3 THEN 'household' ELSE 'furniture' END AS sector
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "line": (
        ("lineitem", "orders"),
        """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS line_id,
        o_custkey AS company_id, l_suppkey AS supplier_id, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS corrected_amount,
        CASE l_linestatus WHEN 'O' THEN 'procurement' ELSE 'capital' END AS flow_type,
        CASE WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN 'corrected' WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'pending' ELSE 'disputed' END AS status,
        l_linenumber = 7 AS withdrawn, CASE WHEN l_linenumber % 2 = 0 THEN 'innovation' ELSE 'capacity' END AS tag_a, CASE WHEN l_quantity > 25 THEN 'large' END AS tag_b,
        year(l_shipdate) AS period, l_shipdate AS reported_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "counted": (
        ("line",),
        """SELECT *, CASE WHEN withdrawn THEN CAST(0 AS DECIMAL(18,4)) WHEN status = 'confirmed' THEN amount WHEN status = 'corrected' THEN coalesce(corrected_amount, amount) ELSE CAST(0 AS DECIMAL(18,4)) END AS confirmed,
        CASE WHEN withdrawn THEN CAST(0 AS DECIMAL(18,4)) ELSE amount END AS reported FROM line""",
    ),
    "commitment": (
        ("orders", "customer", "nation"),
        """SELECT o_orderkey AS id, c_name AS org_name, c_custkey AS org_id, lower(c_mktsegment) AS sector, n_name AS region,
        CASE WHEN c_acctbal < 0 THEN 'small' WHEN c_acctbal < 3000 THEN 'medium' WHEN c_acctbal < 7000 THEN 'large' ELSE 'enterprise' END AS org_size,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'procurement' WHEN '2' THEN 'employment' WHEN '3' THEN 'training' WHEN '4' THEN 'investment' ELSE 'other' END AS type,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'reflect' ELSE 'innovate' END AS rap_type,
        CASE o_orderkey % 5 WHEN 0 THEN 'committed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'reported' WHEN 3 THEN 'confirmed' ELSE 'stalled' END AS status,
        CAST(year(o_orderdate) AS BIGINT) AS target_year, o_orderkey % 101 AS progress, o_orderkey % 4 AS n_history, CAST(o_totalprice AS DECIMAL(18,2)) AS target_value,
        CASE WHEN o_orderkey % 2 = 0 THEN 'currency' ELSE 'count' END AS unit, o_orderpriority || ' for ' || c_name AS title
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "observation": (
        ("events",),
        """SELECT event_id, user_id AS commit_id, ts AS observed_at, event_type, value,
        CASE event_id % 5 WHEN 0 THEN 'not_started' WHEN 1 THEN 'on_track' WHEN 2 THEN 'delayed' WHEN 3 THEN 'met' ELSE 'missed' END AS status FROM events""",
    ),
    "record": (
        ("documents",),
        """SELECT doc_id, text, lang, source, n_chars, 1980 + doc_id % 45 AS year, CASE doc_id % 4 WHEN 0 THEN 'supreme' WHEN 1 THEN 'appeal' WHEN 2 THEN 'superior' ELSE 'tribunal' END AS level,
        CASE WHEN doc_id % 3 = 0 THEN 'substrate' ELSE 'core' END AS tier, CASE doc_id % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' WHEN 2 THEN 'partial' ELSE 'settled' END AS win_type,
        concat(CAST(1980 + doc_id % 45 AS STRING), ' XC ', CAST(doc_id AS STRING)) AS citation, concat('[', CAST(1980 + doc_id % 45 AS STRING), '] R ', CAST(doc_id % 700 AS STRING)) AS citation2, doc_id % 6 <> 0 AS full_text FROM documents""",
    ),
}
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A source or domain table; given frames stand for the tables of their names (a stream's batch, say)."""
    if name in given:
        return given[name]
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, select = VIEWS[name]
    return spark.sql(" ".join(_named(select, needs)), **{n: table(spark, sf_dir, n, **given) for n in needs})


def _named(select: str, needs: tuple[str, ...]) -> list[str]:
    """The SELECT with each table it reads as a parameter of spark.sql."""
    words = select.split()
    return [f"{{{w}}} AS {w}" if w in needs and words[i - 1] in ("FROM", "JOIN") else w for i, w in enumerate(words)]


def oracle(body: str, *names: str) -> str:
    """body with the domain tables it names as common table expressions, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            if n in VIEWS:
                add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + (", " + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else " " + body)
