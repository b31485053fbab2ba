"""Drawings as entity rows, and their SVG and DXF texts, written and read by column expressions.

An entity is (drawing_id, ordinal, kind, layer, a, b, c, d, label) with whole-number coordinates in hundredths of a millimetre: a line from
(a, b) to (c, d), a circle at (a, b) of radius c, or a label at (a, b). Labels hold no markup characters and no line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
KINDS = ("line", "circle", "text")
COLUMNS = ("drawing_id", "ordinal", "kind", "layer", "a", "b", "c", "d", "label")


def problems(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """(drawing_id, ordinal, problem): unknown kinds and layers, circles without radius, labels without text."""
    known = layers.select("drawing_id", "layer", F.lit(True).alias("known"))
    e = entities.join(known, ["drawing_id", "layer"], "left")
    problem = F.when(~c("kind").isin(*KINDS), "unknown_kind").when(c("known").isNull(), "unknown_layer").when((c("kind") == "circle") & (F.coalesce("c", F.lit(0)) <= 0), "no_radius").when((c("kind") == "text") & (F.coalesce("label", F.lit("")) == ""), "no_label")
    return e.select("drawing_id", "ordinal", problem.alias("problem")).where("problem is not null")


def _joined(entities: DataFrame, line: Column, head: str, tail: str, out: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return entities.groupBy("drawing_id").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda z: z["line"]), ""), F.lit(tail)).alias(out))


def to_svg(entities: DataFrame) -> DataFrame:
    """(drawing_id, svg): a drawing's entities in order, one element a line."""
    number = lambda name: F.concat(F.lit(f' {name[0]}="'), c(name[1]).cast("string"), F.lit('"'))
    layer = F.concat(F.lit(' class="'), c("layer"), F.lit('"'))
    line = (
        F.when(c("kind") == "line", F.concat(F.lit("<line"), layer, *map(number, (("x1", "a"), ("y1", "b"), ("x2", "c"), ("y2", "d"))), F.lit("/>\n")))
        .when(c("kind") == "circle", F.concat(F.lit("<circle"), layer, *map(number, (("cx", "a"), ("cy", "b"), ("r", "c"))), F.lit("/>\n")))
        .otherwise(F.concat(F.lit("<text"), layer, *map(number, (("x", "a"), ("y", "b"))), F.lit(">"), c("label"), F.lit("</text>\n")))
    )
    return _joined(entities, line, '<svg xmlns="http://www.w3.org/2000/svg">\n', "</svg>\n", "svg")


def from_svg(drawings: DataFrame) -> DataFrame:
    """The entities of (drawing_id, svg); an element that ``to_svg`` doesn't write is an error."""
    lines = drawings.select("drawing_id", F.posexplode(F.filter(F.split("svg", "\n"), lambda x: (x != "") & ~x.startswith("<svg") & (x != "</svg>"))).alias("ordinal", "e"))
    kind = F.regexp_extract("e", r"^<(line|circle|text) ", 1)
    checked = F.when(kind != "", kind).otherwise(F.raise_error(F.concat(F.lit("a foreign element: "), c("e"))))
    n = lambda name: F.regexp_extract("e", rf' {name}="(-?[0-9]+)"', 1).try_cast("long")
    return lines.select("drawing_id", "ordinal", checked.alias("kind"), F.regexp_extract("e", ' class="([^"]*)"', 1).alias("layer"), F.coalesce(n("x1"), n("cx"), n("x")).alias("a"), F.coalesce(n("y1"), n("cy"), n("y")).alias("b"), F.coalesce(n("x2"), n("r")).alias("c"), n("y2").alias("d"), F.when(kind == "text", F.regexp_extract("e", ">([^<]*)</text>$", 1)).alias("label"))


def to_dxf(entities: DataFrame) -> DataFrame:
    """(drawing_id, dxf): the entities section, a line with a code and a line with its value for each field."""
    pair = lambda code, value: F.concat(F.lit(f"{code}\n"), value.cast("string"), F.lit("\n"))
    head = F.concat(pair(0, F.upper("kind")), pair(8, c("layer")), pair(10, c("a")), pair(20, c("b")))
    line = F.when(c("kind") == "line", F.concat(head, pair(11, c("c")), pair(21, c("d")))).when(c("kind") == "circle", F.concat(head, pair(40, c("c")))).otherwise(F.concat(head, pair(1, c("label"))))
    return _joined(entities, line, "0\nSECTION\n2\nENTITIES\n", "0\nENDSEC\n0\nEOF\n", "dxf")


def from_dxf(drawings: DataFrame) -> DataFrame:
    """The entities of (drawing_id, dxf): pairs of lines, cut where a code 0 starts an entity, and each entity's codes turned into columns."""
    lines = drawings.select("drawing_id", F.posexplode(F.split("dxf", "\n")).alias("at", "v"))
    # a pair's code stands on an even line, its value on the next
    pairs = lines.groupBy("drawing_id", F.floor(c("at") / 2).alias("pair")).agg(F.max(F.when(c("at") % 2 == 0, c("v"))).alias("code"), F.max(F.when(c("at") % 2 == 1, c("v"))).alias("value"))
    order = Window.partitionBy("drawing_id").orderBy("pair").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.where("value is not null").withColumn("entity", F.count_if(c("code") == "0").over(order))
    pick = lambda code: F.max(F.when(c("code") == str(code), c("value")))
    e = pairs.groupBy("drawing_id", "entity").agg(pick(0).alias("kind"), pick(8).alias("layer"), *[pick(k).try_cast("long").alias(f"n{k}") for k in (10, 20, 11, 21, 40)], pick(1).alias("label"))
    e = e.where(~c("kind").isin("SECTION", "ENDSEC", "EOF"))
    checked = F.when(F.lower("kind").isin(*KINDS), F.lower("kind")).otherwise(F.raise_error(F.concat(F.lit("a foreign entity: "), c("kind"))))
    ordinal = F.row_number().over(Window.partitionBy("drawing_id").orderBy("entity")) - 1
    return e.select("drawing_id", ordinal.alias("ordinal"), checked.alias("kind"), "layer", c("n10").alias("a"), c("n20").alias("b"), F.coalesce("n11", "n40").alias("c"), c("n21").alias("d"), "label")
