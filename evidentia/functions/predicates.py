"""Predicates and projections on paths, routes and code text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def is_app_file(path: Column) -> Column:
    return (path != "") & (path != "<empty>") & ~F.translate(path, "\\", "/").rlike(fixed.NON_APP_PATH)


def is_public_route(path: Column) -> Column:
    """The empty path isn't public, / is."""
    return (path != "") & F.regexp_replace(path, r"^\s+|\s+$", "").rlike(fixed.PUBLIC_ROUTE)


def route_path(code: Column) -> Column:
    return F.regexp_extract(code, fixed.ROUTE_PATH, 1)


def route_verb(code: Column) -> Column:
    verb = F.upper(F.regexp_extract(code, fixed.ROUTE_VERB, 1))
    return F.when(verb == "", "?").otherwise(verb)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def language_of(path: Column) -> Column:
    """By the suffix; null if it is none of the known."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def is_url(source: Column) -> Column:
    return source.rlike(r"^(?:https?://|git@|ssh://|git://)")


#: Patterns of route middleware, in order, with the operator and the control that its removal stands for.
MIDDLEWARE = (
    (fixed.PASSPORT, "M1", "authentication"),
    (fixed.MIDDLEWARE_VALIDATION, "M5", "validation"),
    (fixed.MIDDLEWARE_AUTHORIZATION, "M1", "authorization"),
    (fixed.MIDDLEWARE_AUTHENTICATION, "M1", "authentication"),
)


def middleware_class(arg: Column) -> Column:
    """(operator, control) of a route middleware, by the whole argument or its last name; null for handlers and anything unknown."""
    whole = F.trim(arg)
    last = F.trim(F.element_at(F.split(whole, r"\."), -1))
    known = F.lit(None)
    for pattern, operator, control in reversed(MIDDLEWARE):
        known = F.when(whole.rlike(pattern) | last.rlike(pattern), F.struct(F.lit(operator).alias("operator"), F.lit(control).alias("control"))).otherwise(known)
    return F.when((whole != "") & ~whole.rlike(fixed.INLINE_HANDLER), known)


def denies(body: Column) -> Column:
    return body.rlike(fixed.DENIAL)


def guard_condition(condition: Column) -> Column:
    """ownership, authorization or session, tested in this order."""
    return (
        F.when(condition.rlike(fixed.OWNERSHIP_CONDITION), "ownership")
        .when(condition.rlike(fixed.ROLE_CONDITION), "authorization")
        .when(condition.rlike(fixed.SESSION_CONDITION), "session")
    )


def control_classes(*texts: Column, classes: dict[str, tuple[str, ...]] = fixed.CONTROL_CLASSES) -> Column:
    """The classes one of whose words occurs in the texts."""
    blob = F.lower(F.concat_ws(" ", *texts))

    def named(words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(blob, w))

    return F.array_compact(F.array(*[F.when(named(w), c) for c, w in classes.items()]))
