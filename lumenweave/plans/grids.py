"""Queries over HTML tables made of parts: header grids and values by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import grids, topology

from .registry import query

#: A part's table: a stub over two rows, a group as wide as its size says, a group of two, and a P value over both rows.
WIDE = "k AS (SELECT p_partkey, p_brand AS arm, (p_size % 4 + 1)::INT AS k, p_size, p_retailprice FROM part), c AS (SELECT *, unnest(range(0, k + 4)) AS col FROM k)"


def _header(t):
    span = F.col("p_size") % 4 + 1
    cell = lambda tag, text, rows=None, cols=None: F.concat(F.lit(f"<{tag}"), *([F.lit(' rowspan="'), rows, F.lit('"')] if rows is not None else []), *([F.lit(" colspan="), cols.cast("string")] if cols is not None else []), F.lit(">"), text, F.lit(f"</{tag}>"))
    top = F.concat(F.lit("<tr>"), cell("th", F.lit("Outcome"), F.lit("2")), cell("th", F.col("p_brand"), cols=span), cell("td", F.lit("Sham"), cols=F.lit(2)), cell("th", F.lit("P"), F.lit("2")), F.lit("</tr>"))
    names = F.transform(F.sequence(F.lit(1), span), lambda i: F.concat(F.lit("<td>"), F.get(F.array(*map(F.lit, ("n", "Mean (SD)", "95% CI", "Change"))), (i - 1).cast("int")), F.lit("</td>")))
    below = F.concat(F.lit("<tr>"), F.array_join(names, ""), F.lit("<td>Mean (SD)</td><td>n</td></tr>"))
    # Spread first, and by a number, which is not put together again: a small file is one task, and what is made of it is not small.
    part = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    part = part.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select("p_partkey", "p_brand", "p_size", "p_retailprice", span.cast("int").alias("k"), F.array(topology.cell_specs(top), topology.cell_specs(below)).alias("rows"))


@query("wn10_pf15_header_paths", f"""WITH {WIDE} SELECT p_partkey, col, CASE WHEN col = 0 THEN 'Outcome' WHEN col = k + 3 THEN 'P' WHEN col <= k THEN arm || ' > ' || ['n', 'Mean (SD)', '95% CI', 'Change'][col] WHEN col = k + 1 THEN 'Sham > Mean (SD)' ELSE 'Sham > n' END AS path FROM c""")
def header_paths(t):
    """Every column of every table with its path through the header's levels."""
    paths = _header(t).select("p_partkey", F.posexplode(grids.header_paths(grids.header_grid(F.col("rows")))).alias("col", "path"))
    return paths.select("p_partkey", "col", F.array_join("path", " > ").alias("path"))


@query("nm11_column_values", f"""WITH {WIDE}, a AS (SELECT p_partkey, arm, k, p_size, p_retailprice, 'own' AS side FROM k UNION ALL SELECT p_partkey, 'Sham', k, p_size, p_retailprice, 'sham' FROM k)
SELECT p_partkey, CASE side WHEN 'own' THEN ' ' || arm || ' ' ELSE 'sham' END AS arm_label, CASE WHEN side = 'own' AND k >= 2 THEN p_retailprice WHEN side = 'sham' THEN p_size END::DOUBLE AS estimate,
CASE WHEN side = 'own' AND p_size % 3 = 0 THEN -1 WHEN side = 'own' AND k >= 2 THEN p_retailprice WHEN side = 'sham' THEN p_size END::DOUBLE AS value, CASE WHEN side = 'own' AND k >= 2 THEN 25e-1 WHEN side = 'sham' THEN 1 END::DOUBLE AS sd,
CASE WHEN side = 'own' THEN p_size WHEN p_size % 2 = 0 THEN 40 END::BIGINT AS n, CASE WHEN side = 'own' AND k >= 3 THEN -p_size END::DOUBLE AS lower, CASE WHEN side = 'own' AND k >= 3 THEN p_size END::DOUBLE AS upper FROM a""")
def column_values(t):
    """One row of values a table: arms filled by what their columns' headers say, given values kept."""
    wide = _header(t)
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    own = F.array(size, F.concat(price, F.lit(" ± 2.5")), F.concat(F.lit("−"), size, F.lit(" to "), size), F.lit("see text"))
    values = F.concat(F.array(F.lit("Pain")), F.slice(own, F.lit(1), F.col("k")), F.array(F.concat(size, F.lit(" (-1)")), F.when(F.col("p_size") % 2 == 0, "40").otherwise("40.5"), F.lit("<0.05")))
    cells = wide.select("p_partkey", F.lit(0).alias("row"), F.posexplode(values).alias("col", "cell"))
    paths = wide.select("p_partkey", F.posexplode(grids.header_paths(grids.header_grid(F.col("rows")))).alias("col", "path"))
    last = F.element_at("path", -1)
    kind = F.when(last == "n", "n").when(last == "Mean (SD)", "mean_sd").when(last == "95% CI", "confidence_interval").when(last == "P", "p_value").otherwise("effect")
    columns = paths.select("p_partkey", "col", F.when(F.size("path") > 1, F.get("path", 0)).otherwise("NR").alias("arm_label"), kind.alias("statistic"))
    given = F.when(F.col("p_size") % 3 == 0, F.lit(-1.0))
    arms = wide.select("p_partkey", F.lit(0).alias("row"), F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("arm_label"), given.alias("value")).unionByName(
        wide.select("p_partkey", F.lit(0).alias("row"), F.lit("sham").alias("arm_label"), F.lit(None).cast("double").alias("value"))
    )
    return grids.projected(cells, columns, arms, "p_partkey").select("p_partkey", "arm_label", *grids.FIELDS)
