"""Request flows: entry points, bounded traces through the call graph, diagrams.

Sizes here follow from the limits, not from the data: at most MAX_FLOWS
entries, and calls that one of MAX_STEPS steps can be in MAX_DEPTH + 1 levels.
Tables that grow with the tree (calls, methods, classes) are only ever scanned
against such bounded sides, which are broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import layers
from sourceloom.functions.naming import identifier, last_segment
from sourceloom.functions.rules import (
    CLIENT, CLIENT_RANK, EXTERNAL_PREFIXES, EXTERNAL_RANK, MAX_DEPTH, MAX_FLOWS, MAX_STEPS,
)
from sourceloom.operators.calls import calls_by_caller
from sourceloom.operators.tables import zipped
from sourceloom.session import written

_CALLER, _CALLEE = ["caller_class", "caller_method"], ["callee_class", "callee_method"]
_STEP = "caller_class string, caller_method string, callee_class string, callee_method string"


def entry_points(methods: DataFrame, edges: DataFrame, limit: int = MAX_FLOWS) -> DataFrame:
    """flow_ord, entry_class, entry_method: public methods that call something, best first.

    Order: route annotation, not called by others, most calls, name.  Overloads
    are candidates each; they are counted before the join and counted out again
    only among the best `limit`.
    """
    key = ["entry_class", "entry_method"]
    wanted = (
        methods.filter("is_entry_candidate")
        .groupBy(F.col("fqn").alias(key[0]), F.col("name").alias(key[1]), F.col("route").isNotNull().alias("has_route"))
        .agg(F.count("*").alias("n_overloads"))
    )
    outgoing = edges.groupBy(*[F.col(c).alias(k) for c, k in zip(_CALLER, key)]).agg(F.count("*").alias("n_calls"))
    called = edges.select(*[F.col(c).alias(k) for c, k in zip(_CALLEE, key)]).distinct().withColumn("is_called", F.lit(True))
    order = [F.desc("has_route"), F.asc("is_called"), F.desc("n_calls"), *map(F.asc, key)]
    best = (
        wanted.join(outgoing.hint("merge"), key)
        .join(called.hint("merge"), key, "left")
        .withColumn("is_called", F.coalesce("is_called", F.lit(False)))
        .orderBy(*order)
        .limit(limit)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n_overloads"), F.lit(limit)).cast("int"))))
    )
    rank = F.struct(~F.col("has_route"), "is_called", -F.col("n_calls"), *key, "copy")
    ranked = best.agg(F.slice(F.array_sort(F.collect_list(rank)), 1, limit).alias("r")).select(F.posexplode("r").alias("i", "r"))
    return ranked.select((F.col("i") + 1).alias("flow_ord"), "r.entry_class", "r.entry_method")


def sole_implementors(resolved_implements: DataFrame) -> DataFrame:
    """(interface, implementor) of every interface with exactly one implementing class."""
    return (
        resolved_implements.filter("target_kind = 'interface'")
        .groupBy(F.col("target").alias("interface"))
        .agg(F.count("*").alias("n"), F.min("src").alias("implementor"))
        .filter("n = 1")
        .drop("n")
    )


def reachable_calls(entries: DataFrame, edges: DataFrame, redirects: DataFrame, steps: int = MAX_STEPS, depth: int = MAX_DEPTH) -> DataFrame:
    """Per flow, the calls a trace from its entry could take, callees redirected to sole implementors.

    One level per round; a round reads `edges` once against the broadcast frontier.  A trace
    takes all earlier calls of a method before a later one, so a call is step number (sum of the ranks
    along its path) at the earliest; beyond `steps` it is left out.  So a flow has at most as many
    paths as sums of `depth` + 1 ranks stay within `steps` (792 for 12 and 5), however many calls methods have.
    A method is followed again only if it is reached with a smaller sum than before.
    """
    method = ["flow_ord", *_CALLER]
    frontier = entries.select("flow_ord", F.col("entry_class").alias(_CALLER[0]), F.col("entry_method").alias(_CALLER[1]), F.lit(0).alias("spent")).distinct()
    reached, seen = None, frontier
    for level in range(depth + 1):
        calls = calls_by_caller(edges.join(F.broadcast(frontier.select(*_CALLER).distinct()), _CALLER, "left_semi"), steps)
        calls = frontier.join(calls, _CALLER).withColumn("spent", (F.col("spent") + F.col("call_rank")).cast("int")).filter(F.col("spent") <= steps)
        names = calls.select(F.col("callee_class").alias("interface")).distinct()
        bound = redirects.join(F.broadcast(names), "interface").select(F.col("interface").alias("callee_class"), "implementor")
        calls = calls.join(F.broadcast(bound), "callee_class", "left").withColumn(
            "callee_class", F.coalesce("implementor", "callee_class")
        )
        calls = written(calls.select("flow_ord", "call_rank", *_CALLER, *_CALLEE, "spent"), f"calls-level-{level}")
        reached = calls if reached is None else reached.unionByName(calls)
        if calls.isEmpty():
            break
        target = calls.filter(F.col("spent") < steps).groupBy("flow_ord", *[F.col(c).alias(k) for c, k in zip(_CALLEE, _CALLER)]).agg(F.min("spent").alias("spent"))
        before = seen.groupBy(*method).agg(F.min("spent").alias("before"))
        frontier = target.join(F.broadcast(before), method, "left").filter("before is null or spent < before").drop("before")
        seen = seen.unionByName(frontier)
    return reached.drop("spent").distinct()


def _tracer(steps_at_most: int, depth: int):
    def trace(flow: pd.DataFrame) -> pd.DataFrame:
        """Depth-first walk of one flow: a method is expanded once, to a depth and a number of steps."""
        follow: dict = {}
        for row in flow[flow["call_rank"] > 0].sort_values("call_rank").itertuples():
            follow.setdefault((row.caller_class, row.caller_method), []).append(
                (row.caller_class, row.caller_method, row.callee_class, row.callee_method)
            )
        start = next(flow[flow["call_rank"] == 0].itertuples())
        entry = (start.caller_class, start.caller_method)
        steps, expanded, open_calls = [], {entry}, [iter(follow.get(entry, ()))]
        while open_calls and len(steps) < steps_at_most:
            step = next(open_calls[-1], None)
            if step is None:
                open_calls.pop()
                continue
            steps.append(step)
            if len(open_calls) <= depth and len(steps) < steps_at_most and step[2:] not in expanded:
                expanded.add(step[2:])
                open_calls.append(iter(follow.get(step[2:], ())))
        out = pd.DataFrame(steps, columns=[*_CALLER, *_CALLEE])
        return out.assign(flow_ord=start.flow_ord, step_ord=range(1, len(out) + 1))

    return trace


def trace_flows(entries: DataFrame, reached: DataFrame, steps: int = MAX_STEPS, depth: int = MAX_DEPTH) -> DataFrame:
    """flow_ord, step_ord and the calls of every flow; one flow per task.  `reached` is for as many `steps` and `depth`."""
    starts = entries.select(
        "flow_ord", F.lit(0).alias("call_rank"), F.col("entry_class").alias(_CALLER[0]), F.col("entry_method").alias(_CALLER[1]),
        *[F.lit("").alias(c) for c in _CALLEE],
    )
    rows = starts.unionByName(reached)
    return rows.groupBy("flow_ord").applyInPandas(_tracer(steps, depth), f"{_STEP}, flow_ord int, step_ord int")


def class_details(rows: DataFrame, syms: DataFrame, names: DataFrame) -> DataFrame:
    """Routes and methods of a bounded set of classes `names` (fqn)."""
    places = syms.join(F.broadcast(names), "fqn").select("fqn", "path", "class_ord", "layer")
    methods = zipped("methods", "name", "return_type", "annotations", "annotation_args").alias("methods")
    return rows.select("path", "class_ord", "annotations", "annotation_args", methods).join(F.broadcast(places), ["path", "class_ord"])


def build_flows(rows: DataFrame, syms: DataFrame, edges: DataFrame, methods: DataFrame,
                redirects: DataFrame, categories: DataFrame) -> DataFrame:
    """flow_ord, entry, steps, label and diagram of every flow; at most MAX_FLOWS rows."""
    entries = written(entry_points(methods, edges), "entries")
    steps = written(trace_flows(entries, reachable_calls(entries, edges, redirects)), "steps")
    return describe_flows(entries, steps, rows, syms, categories)


def describe_flows(entries: DataFrame, steps: DataFrame, rows: DataFrame, syms: DataFrame, categories: DataFrame) -> DataFrame:
    names = (
        steps.select(F.explode(F.array("caller_class", "callee_class")).alias("fqn"))
        .unionByName(entries.select(F.col("entry_class").alias("fqn")))
        .distinct()
    )
    details = written(class_details(rows, syms, names), "flow-classes")
    returns = (
        details.select("fqn", F.posexplode("methods").alias("method_ord", "m"))
        .groupBy("fqn", F.col("m.name").alias("method"))
        .agg(F.min_by(F.struct("m.return_type", "m.annotations", "m.annotation_args"), "method_ord").alias("m"))
        .select("fqn", "method", F.nullif(F.nullif("m.return_type", F.lit("")), F.lit("void")).alias("return_type"), "m")
    )
    callee = returns.select(F.col("fqn").alias("callee_class"), F.col("method").alias("callee_method"), "return_type")
    shown = steps.join(F.broadcast(callee), _CALLEE, "left")
    step = F.struct("step_ord", *_CALLER, *_CALLEE, "return_type")
    listed = shown.groupBy("flow_ord").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    last = F.element_at("steps", -1)
    place = details.select(F.col("fqn").alias("last_class"), "path")
    sinks = categories.select("path", "first_category").join(F.broadcast(place), "path").select("last_class", "first_category")
    sink = F.struct(
        (last["step_ord"] + 1).alias("step_ord"), last["callee_class"].alias("caller_class"),
        last["callee_method"].alias("caller_method"), F.col("first_category").alias("callee_class"),
        last["callee_method"].alias("callee_method"), F.lit("result").alias("return_type"),
    )
    ended = (
        listed.withColumn("last_class", last["callee_class"])
        .join(F.broadcast(sinks), "last_class", "left")
        .withColumn("steps", F.when(F.col("first_category").isNull(), F.col("steps")).otherwise(F.array_append("steps", sink)))
    )

    class_route = layers.route_annotation(F.col("annotations"))
    class_paths = details.select(
        F.col("fqn").alias("entry_class"), F.try_element_at("annotation_args", class_route).alias("class_path")
    )
    route = layers.route_annotation(F.col("m.annotations"))
    heads = (
        entries.join(F.broadcast(class_paths), "entry_class", "left")
        .join(
            F.broadcast(returns.select(F.col("fqn").alias("entry_class"), F.col("method").alias("entry_method"), "m", "return_type")),
            ["entry_class", "entry_method"], "left",
        )
        .select(
            "flow_ord", "entry_class", "entry_method", F.col("return_type").alias("entry_return"),
            F.coalesce(
                layers.route_label(F.col("class_path"), route, F.try_element_at("m.annotation_args", route)),
                F.concat("entry_method", F.lit("()")),
            ).alias("entry_label"),
        )
    )
    rank = F.struct("fqn", layers.layer_rank(F.col("layer")).alias("rank"))
    ranks = details.agg(F.collect_list(rank)).scalar()
    flows = heads.join(ended.select("flow_ord", "steps"), "flow_ord").withColumn("ranks", ranks)
    return flows.select(
        "flow_ord", "entry_class", "entry_method", "entry_label", "entry_return",
        F.transform("steps", lambda s: s.dropFields("step_ord")).alias("steps"), _diagram().alias("mermaid"),
    )


def _diagram() -> Column:
    """The Mermaid text of one flow row (entry_*, steps, ranks)."""

    def pid(c):
        return identifier(c, "P")

    def arrow(a, how, b, text):
        return F.concat(F.lit("    "), pid(a), F.lit(how), pid(b), F.lit(": "), text)

    client, entry, steps = F.lit(CLIENT), F.col("entry_class"), F.col("steps")
    outside = list(EXTERNAL_PREFIXES)
    people = F.array_distinct(
        F.concat(F.array(client, entry), F.flatten(F.transform(steps, lambda s: F.array(s["caller_class"], s["callee_class"]))))
    )

    def rank(p):
        known = F.get(F.filter("ranks", lambda r: r["fqn"] == p), 0)["rank"]
        return (
            F.when(p == CLIENT, CLIENT_RANK)
            .when(p.isin(*outside), EXTERNAL_RANK)
            .otherwise(F.coalesce(known, layers.layer_rank(F.lit(None).cast("string"))))
        )

    ordered = F.array_sort(F.transform(people, lambda p, i: F.struct(rank(p).alias("rank"), i.alias("seen"), p.alias("who"))))
    label = lambda p: F.when((p == CLIENT) | p.isin(*outside), p).otherwise(last_segment(p))
    lines = F.concat(
        F.array(F.lit("sequenceDiagram")),
        F.transform(ordered, lambda o: F.concat(F.lit("    participant "), pid(o["who"]), F.lit(" as "), label(o["who"]))),
        F.array(arrow(client, "->>", entry, F.col("entry_label"))),
        F.transform(steps, lambda s: arrow(s["caller_class"], "->>", s["callee_class"], F.concat(s["callee_method"], F.lit("()")))),
        F.transform(
            F.filter(F.reverse(steps), lambda s: s["return_type"].isNotNull()),
            lambda s: arrow(s["callee_class"], "-->>", s["caller_class"], s["return_type"]),
        ),
        F.when(F.col("entry_return").isNotNull(), F.array(arrow(entry, "-->>", client, F.col("entry_return")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return F.array_join(lines, "\n")
