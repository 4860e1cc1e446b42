"""Left edges of a page's lines in groups, and what the groups stand for, as columns: folds in the order of the lines, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

X0_TOLERANCE, METRIC_TOLERANCE = 7.0, 15.0
#: Types whose expected distance from the paragraphs' edge is looked up, in this order.
ASSIGNED = ("paragraph-start", "footnote-text", "footnote-start", "quote-text")
GROUP = "struct<n:long,sum:double,min_x0:double,max_x0:double,width_sum:double,max_width:double>"
METRICS = "array<struct<type:string,min_x0:double,max_x0:double,average_width:double,max_width:double>>"


def _mean(g: Column) -> Column:
    return g["sum"] / g["n"]


def edge_groups(lines: Column) -> Column:
    """Groups of left edges by their mean: each edge, ascending, joins the first group whose mean is within 7, else begins one.

    lines: array of structs with x0 and x1. Widths keep the order of the lines while edges are sorted, so a group's widths are
    those of other lines: known, and kept for equal results."""
    edges = F.array_sort(F.transform(lines, lambda x: x["x0"].cast("double")))
    widths = F.transform(lines, lambda x: (x["x1"] - x["x0"]).cast("double"))
    both = F.zip_with(edges, widths, lambda x, w: F.struct(x.alias("x"), w.alias("w")))

    def with_edge(g: Column, e: Column) -> Column:
        return F.struct((g["n"] + 1).alias("n"), (g["sum"] + e["x"]).alias("sum"), g["min_x0"].alias("min_x0"), e["x"].alias("max_x0"), (g["width_sum"] + e["w"]).alias("width_sum"), F.greatest(g["max_width"], e["w"]).alias("max_width"))

    def step(groups: Column, e: Column) -> Column:
        new = F.struct(F.lit(1).cast("long").alias("n"), e["x"].alias("sum"), e["x"].alias("min_x0"), e["x"].alias("max_x0"), e["w"].alias("width_sum"), e["w"].alias("max_width"))
        first = F.array_position(F.transform(groups, lambda g: F.abs(e["x"] - _mean(g)) <= X0_TOLERANCE), F.lit(True)) - 1
        return let(first, lambda k: F.when(k < 0, F.concat(groups, F.array(new))).otherwise(F.transform(groups, lambda g, i: F.when(i == k, with_edge(g, e)).otherwise(g))))

    found = F.aggregate(both, F.array().cast(f"array<{GROUP}>"), step)
    by_mean = F.array_sort(F.transform(found, lambda g, i: F.struct(_mean(g).alias("mean"), i.alias("i"), g.alias("g"))))
    return F.transform(by_mean, lambda x: x["g"])


def edge_metrics(lines: Column, offsets: dict) -> Column:
    """Ranges of left edges by type, in order of assignment: the group with most lines is paragraph text, each type that has an expected
    distance from it takes the nearest free group within its tolerance, the rest is unknown. An empty page has none.

    offsets: a distance by type, or {"expected_x0", "tolerance"}."""

    def metric(kind: Column, g: Column) -> Column:
        return F.struct(kind.alias("type"), g["min_x0"].alias("min_x0"), g["max_x0"].alias("max_x0"), (g["width_sum"] / g["n"]).alias("average_width"), g["max_width"].alias("max_width"))

    def assign(groups: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(groups) - 1)
        body = F.array_max(F.transform(at, lambda i: F.struct(F.get(groups, i)["n"].alias("n"), (-i).alias("i"))))["i"]
        taken = let(-body, lambda b: _assign_types(groups, at, b, offsets))
        rest = lambda t: F.filter(at, lambda i: ~F.exists(t, lambda x: x["i"] == i))
        named = lambda t: F.concat(t, F.transform(rest(t), lambda i, k: F.struct(F.concat(F.lit("unknown-"), (k + 1).cast("string")).alias("type"), i.alias("i"))))
        return let(taken, lambda t: F.transform(named(t), lambda x: metric(x["type"], F.get(groups, x["i"]))))

    return F.when(F.size(lines) > 0, let(edge_groups(lines), assign)).otherwise(F.array().cast(METRICS))


def _assign_types(groups: Column, at: Column, body: Column, offsets: dict) -> Column:
    def taking(name: str, offset: float, tolerance: float):
        away = lambda i: F.abs(_mean(F.get(groups, i)) - _mean(F.get(groups, body)) - offset)
        free = lambda t: F.filter(at, lambda i: ~F.exists(t, lambda x: x["i"] == i))
        nearest = lambda t: F.array_min(F.transform(free(t), lambda i: F.struct(away(i).alias("d"), i.alias("i"))))
        one = lambda x: F.array(F.struct(F.lit(name).alias("type"), x["i"].alias("i")))
        return lambda t: let(nearest(t), lambda x: F.when(x["d"] <= tolerance, F.concat(t, one(x))).otherwise(t))

    out = F.array(F.struct(F.lit("paragraph-text").alias("type"), body.alias("i")))
    for name in ASSIGNED:
        spec = offsets.get(name)
        offset, tolerance = (spec.get("expected_x0"), spec.get("tolerance") or METRIC_TOLERANCE) if isinstance(spec, dict) else (spec, METRIC_TOLERANCE)
        if offset is not None:
            out = let(out, taking(name, float(offset), float(tolerance)))
    return out


# -- assembly -------------------------------------------------------------------------------

def glue(first: Column, second: Column) -> Column:
    """Two pages: with a space, or glued if a hyphen ends the first and the second doesn't begin with a capital. Empty ones add nothing."""
    return F.when((first == "") | (second == ""), F.concat(first, second)).otherwise(F.concat(_left(first, second), second))


def _left(first: Column, second: Column) -> Column:
    """What stands of a page, and between it and what follows."""
    head = F.substring(second, 1, 1)
    return let(F.rtrim(first, F.lit(" \t")), lambda f: F.when(f.endswith("-") & (head == F.lower(head)), F.substring(f, F.lit(1), F.length(f) - 1)).otherwise(F.concat(f, F.lit(" "))))


def join_texts(pages: Column) -> Column:
    """All pages (an array of strings, in order) glued one after the other, in linear time.

    What a page leaves of the text before it is decided by that text's end. A page with any character but blanks and hyphens
    settles it, so each such page takes those that follow without one, and the parts meet only at their edges."""
    full = F.filter(pages, lambda p: F.coalesce(p, F.lit("")) != "")

    def build(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | F.regexp_like(F.get(p, i), F.lit(r"[^ \t-]")))
        after = lambda i, k, a: F.coalesce(F.get(a, k + 1), F.size(p)) - i
        part = lambda i, k, a: F.aggregate(F.slice(p, i + 2, after(i, k, a) - 1), F.get(p, i), glue)
        return let(at, lambda a: let(F.transform(a, lambda i, k: part(i, k, a)), meet))

    def meet(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda x, k: F.when(k == last, x).otherwise(_left(x, F.get(parts, k + 1)))), "")

    return let(full, lambda p: F.when(F.size(p) == 0, F.lit("")).otherwise(build(p)))
