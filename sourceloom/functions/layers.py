"""Architectural layer of a class, from its own row alone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.naming import name_words, words


def _has_any(values: Column, wanted) -> Column:
    return F.arrays_overlap(values, words(wanted))


def all_annotations(annotations: Column, methods: Column) -> Column:
    return F.array_union(annotations, F.flatten(methods["annotations"]))


def holds_data(kind: Column, fields: Column, methods: Column) -> Column:
    """Enum, or instance fields none of which is ever called upon."""
    named = F.arrays_zip(fields["name"].alias("name"), fields["modifiers"].alias("modifiers"))
    own = F.filter(named, lambda f: ~F.array_contains(f["modifiers"], "static"))["name"]
    receivers = F.filter(F.flatten(methods["calls"])["receiver"], lambda r: r.isNotNull())
    return (kind == "enum") | ((F.size(own) > 0) & ~F.arrays_overlap(own, receivers))


def layer(qualified_name: Column, kind: Column, annotations: Column, fields: Column, methods: Column) -> Column:
    """api / service / domain / data, or NULL: annotations first, then name words, then shape."""
    marks, named = all_annotations(annotations, methods), name_words(qualified_name)
    return (
        F.when(_has_any(marks, rules.API_ANNOTATIONS), "api")
        .when(_has_any(marks, rules.DOMAIN_ANNOTATIONS), "domain")
        .when(_has_any(marks, rules.DATA_ANNOTATIONS), "data")
        .when(_has_any(marks, rules.SERVICE_ANNOTATIONS), "service")
        .when(_has_any(named, rules.API_WORDS), "api")
        .when(_has_any(named, rules.DATA_WORDS), "data")
        .when(holds_data(kind, fields, methods), "domain")
    )


def layer_rank(layer_name: Column) -> Column:
    rank = F.lit(rules.UNRANKED_LAYER)
    for name, value in rules.LAYER_RANKS.items():
        rank = F.when(layer_name == name, value).otherwise(rank)
    return rank


def layer_label(layer_name: Column) -> Column:
    label = F.lit("Other")
    for name, value in rules.LAYER_LABELS.items():
        label = F.when(layer_name == name, value).otherwise(label)
    return label


def is_route_handler(annotations: Column, methods: Column) -> Column:
    return _has_any(all_annotations(annotations, methods), rules.ROUTE_ANNOTATIONS)


def route_annotation(annotations: Column) -> Column:
    return F.get(F.filter(annotations, lambda a: a.isin(*rules.ROUTE_ANNOTATIONS)), 0)


def route_label(class_path: Column, method_route: Column, method_path: Column) -> Column:
    """`GET /base/path`; NULL where the method has no route annotation."""
    verbs = F.create_map(*[F.lit(x) for pair in rules.ROUTE_VERBS.items() for x in pair])
    verb = F.element_at(verbs, method_route)
    base, own = F.coalesce(class_path, F.lit("")), F.coalesce(method_path, F.lit(""))
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(own, "^/+", ""))
    path = F.coalesce(F.nullif(F.regexp_replace(joined, "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(method_route.isNotNull(), F.concat_ws(" ", verb, path))


def is_entry_candidate(class_modifiers: Column, method: Column) -> Column:
    return (
        ~method["is_constructor"]
        & F.array_contains(method["modifiers"], "public")
        & F.array_contains(class_modifiers, "public")
        & ~_has_any(method["annotations"], rules.TEST_ANNOTATIONS)
    )


def external_category(import_path: Column) -> Column:
    """STRUCT<category, prefix> of the first listed prefix the import starts with; NULL if none.

    No listed prefix extends one of another category, so an import has at most one category.
    """
    known = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(p).alias("prefix"))
            for c, prefixes in rules.EXTERNAL_PREFIXES.items()
            for p in prefixes
        ]
    )
    return F.get(F.filter(known, lambda k: F.startswith(import_path, k["prefix"])), 0)
