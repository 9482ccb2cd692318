"""The text of an API entry (schemas.TYPE): header lines, then blocks of member lines, in the grammar that `grammar` reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar
from .binding import let

#: The phrase of what is declared and does nothing, the note of an empty name, and how long reasons, summaries and
#: values may be.
NOT_IMPLEMENTED = grammar.LIMITATION
EMPTY_NAME = "Note: this exported name is an empty placeholder at runtime; the working class is "
REASON, SHORT_REASON, SUMMARY, VALUE = 200, 120, 120, 200


def _one(x: Column) -> Column:
    """On one line; empty where there is nothing."""
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def _said(x: Column, before: str = "", after: str = "") -> Column:
    """before, x and after; empty where x is."""
    return let(_one(x), lambda own: F.when(own == "", "").otherwise(F.concat(F.lit(before), own, F.lit(after))))


def _short(x: Column, most: int) -> Column:
    return let(_one(x), lambda own: F.when(F.length(own) > most, F.concat(F.substring(own, 1, most - 3), F.lit("..."))).otherwise(own))


def _type(x: Column) -> Column:
    return F.btrim(F.regexp_replace(_one(x), r"\A:\s*", ""))


def _list(items: Column, between: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(items, _one), lambda x: x != ""), between)


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def stub(e: Column) -> Column:
    reason = _said(_short(e["stub_reason"], SHORT_REASON), ": ")
    return F.when(_yes(e["stub"]), F.concat(F.lit(NOT_IMPLEMENTED), reason)).otherwise("")


def deprecated(e: Column) -> Column:
    return F.when(_yes(e["deprecated"]), F.concat(F.lit(" (deprecated"), _said(F.substring(_one(e["deprecated_reason"]), 1, REASON), ": "), F.lit(")"))).otherwise("")


def _origin(e: Column) -> Column:
    return F.when(F.coalesce(e["promoted_from"], F.lit("")) != "", _said(e["promoted_from"], "  (promoted from ", ")")).otherwise(_said(e["inherited_from"], "  (inherited from ", ")"))


def parameters(params: Column) -> Column:
    """name: type = default, with the marks of keyword-only and positional-only parameters."""
    default = lambda p: _said(p["default"], " = ")
    mark = lambda p: F.when(_yes(p["optional"]) & (default(p) == ""), "?").otherwise("")
    own = lambda p: F.concat(F.when(F.coalesce(p["name"], F.lit("")) == "", _type(p["type"])).otherwise(F.concat(p["name"], mark(p), _said(_type(p["type"]), ": "))), default(p))
    starred = lambda p: F.coalesce((p["kind"] == "var_positional") | F.regexp_like(p["name"], F.lit(r"\A\*(?!\*)")), F.lit(False))
    is_ = lambda p, kind: F.coalesce(p["kind"] == kind, F.lit(False))
    first = lambda i: ~F.exists(F.slice(params, 1, i), lambda p: is_(p, "keyword_only")) & ~F.exists(F.slice(params, 1, i + 1), starred)
    last = lambda i: ~F.exists(F.slice(params, i + 2, F.size(params)), lambda p: is_(p, "positional_only"))
    texts = F.transform(params, lambda p, i: F.concat_ws(", ", F.when(is_(p, "keyword_only") & first(i), "*"), own(p), F.when(is_(p, "positional_only") & last(i), "/")))
    return F.coalesce(F.array_join(texts, ", "), F.lit(""))


def method(m: Column) -> Column:
    """One line, without the bullet: what a caller writes, then in brackets what else is known."""
    file = F.replace(F.coalesce(m["file"], F.lit("")), F.lit("\\"), F.lit("/"))
    mixin = F.when(F.coalesce(m["mixin"], F.lit("")) != "", F.concat(F.lit("  (mixin "), F.concat_ws(", ", m["mixin"], F.nullif(file, F.lit(""))), F.lit(")"))).otherwise("")
    inside = F.concat_ws(", ", F.nullif(_one(m["receiver"]), F.lit("")), F.nullif(parameters(m["params"]), F.lit("")))
    return F.concat(
        F.coalesce(m["name"], F.lit("")), F.lit("("), inside, F.lit(")"), _said(_type(m["return_type"]), " -> "), _said(_list(m["throws"]), " throws "), _said(_list(m["modifiers"]), " [", "]"),
        _said(F.concat_ws(" ", _one(m["generics"]), _one(m["where"])), "  [generic ", "]"), mixin, _origin(m), deprecated(m), _said(stub(m), "  (", ")"), _said(_short(m["doc"], SUMMARY), "  (", ")"),
    )


def property_(p: Column) -> Column:
    mode = F.when(p["access_mode"] == "readwrite", "writable").when(p["access_mode"].isin("readonly", "read_only"), "read-only")
    writable = F.coalesce(F.when(p["writable"], "writable").when(~p["writable"], "read-only"), mode, F.lit(""))
    return F.concat(F.coalesce(p["name"], F.lit("")), _said(_type(p["type"]), ": "), _said(p["value"], " = "), _said(_list(p["modifiers"]), " [", "]"), _said(writable, " (", ")"), _origin(p), deprecated(p), _said(stub(p), "  (", ")"))


def enum_member(m: Column) -> Column:
    payload = _one(m["payload"])
    name = F.concat(F.coalesce(m["name"], F.lit("")), F.when(payload.startswith("{"), " ").otherwise(""), payload)
    return F.concat(name, F.when(F.coalesce(m["value"], F.lit("")) == "", "").otherwise(F.concat(F.lit(" = "), m["value"])), _said(stub(m), "  (", ")"))


def _not_of_a_base(m: Column) -> Column:
    """A constructor or destructor of a base is none of the type."""
    base = F.element_at(F.split(F.btrim(m["inherited_from"]), r"\.|::"), -1)
    made = _yes(m["is_constructor"]) | F.coalesce(m["name"].startswith("~") | m["name"].isin("constructor", "__init__") | ((base != "") & (m["name"] == base)), F.lit(False))
    return ~((F.coalesce(m["inherited_from"], F.lit("")) != "") & made)


def method_lines(methods: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(methods, _not_of_a_base), method))


def property_lines(properties: Column) -> Column:
    """Of each name the first."""
    first = let(F.transform(properties, lambda p: F.coalesce(p["name"], F.lit(""))), lambda names: F.filter(properties, lambda p, i: F.array_position(names, F.coalesce(p["name"], F.lit(""))) == i + 1))
    return F.transform(first, property_)


def _block(name: str, lines: Column) -> Column:
    """A block with an empty line before it; null where there are no lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{name}:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x)), "\n")))


def symbol(e: Column, name: Column, as_method: Callable[[Column], Column], defined_in: Column, exported_as: Column, coverage: Column) -> Column:
    """The text of an entry under a name. One that is defined elsewhere (defined_in) points there and lists no members;
    exported_as: the names that point here. as_method: an entry as its only method, for a function's signature."""
    empty = F.lit("")
    line = lambda title, x: F.nullif(_said(x, f"{title}: "), empty)
    members = n_members(e)
    here, function = defined_in.isNull(), F.coalesce(e["kind"] == "function", F.lit(False))
    package = F.nullif(_one(e["package"]), empty)
    value = F.coalesce(e["value"], empty)
    value = F.when(F.length(value) > VALUE, F.concat(F.substring(value, 1, VALUE), F.lit("..."))).otherwise(value)
    stated = F.when(package.isNotNull(), F.rtrim(F.concat(F.lit("\nValue: "), F.concat_ws(" ", F.nullif(_type(e["type"]), empty), F.nullif(F.concat(F.lit("= "), F.nullif(value, empty)), empty))))).otherwise(F.concat(F.lit("\nValue: "), F.coalesce(e["type"], empty), F.lit(" = "), value))
    is_value = F.coalesce((e["kind"] == "constant") | e["value"].isNotNull(), F.lit(False))
    signed = e["params"].isNotNull() | e["return_type"].isNotNull()
    methods = F.when(F.coalesce(F.size(e["methods"]), F.lit(0)) > 0, method_lines(e["methods"])).when(signed, method_lines(F.array(as_method(e))))
    own = F.concat_ws(
        "\n",
        F.when(~function, line("Generics", F.concat_ws(" ", _one(e["generics"]), _one(e["where"])))), line("Derives", _list(e["derives"])), line("Underlying", e["underlying"]), F.nullif(e["doc"], empty), F.when(is_value, stated),
        _block("Bases", e["bases"]), _block("Methods", methods), _block("Properties", property_lines(e["properties"])), _block("Members", F.transform(e["enum_members"], enum_member)),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("FQN: "), name), F.concat(F.lit("Kind: "), F.coalesce(e["kind"], empty)),
        F.when(_yes(e["deprecated"]), F.concat(F.lit("Deprecated: "), F.coalesce(F.nullif(F.substring(_one(e["deprecated_reason"]), 1, REASON), empty), F.lit("yes")))),
        F.when(~function, line("Limitation", stub(e))), line("Defined-In", defined_in),
        F.nullif(F.array_join(F.transform(exported_as, lambda x: F.concat(F.lit("Exported-As: "), x)), "\n"), empty),
        line("Shadows", e["shadows"]), F.when(members == 0, F.nullif(_said(e["shadows"], EMPTY_NAME), empty)), line("Shadowed-By", e["shadowed_by"]), line("Alias-Of", e["alias_of"]),
        F.concat(F.lit("Package: "), package), F.when(package.isNotNull(), line("Import", e["import_path"])), F.concat(F.lit("Qualified: "), package, F.lit("."), F.nullif(e["name"], empty)),
        F.when(here, F.nullif(own, empty)), F.concat(F.lit("\nAPI-Coverage: "), coverage),
    )


def n_members(e: Column) -> Column:
    """How many methods, properties and members an entry lists."""
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    return size(e["methods"]) + size(e["properties"]) + size(e["enum_members"])
