"""The kinds of blocks: report order, section headers and the sets that rules refer to."""

from __future__ import annotations

#: Kind, section header, and the sets the kind belongs to. The order is the order of report sections.
KINDS = [
    ("import", "Imports", ""),
    ("constant", "Constants", "value"),
    ("variable", "Variables", "value"),
    ("class", "Classes", ""),
    ("interface", "Interfaces", ""),
    ("type_alias", "Type Aliases", ""),
    ("concept", "Concepts", "isolated"),
    ("enum", "Enums", ""),
    ("function", "Functions", "callable collapsible function hoistable"),
    ("macro_function", "Macro Functions", "callable function"),
    ("method", "Methods", "callable collapsible function hoistable"),
    ("arrow_function", "Arrow Functions", "callable collapsible function"),
    ("lambda", "Lambdas", "callable collapsible function"),
    ("object_method", "Object Methods", "callable collapsible function hoistable"),
    ("lifecycle", "Lifecycle", "callable collapsible function"),
    ("jsx", "JSX", "element collapsible"),
    ("template", "Templates", "element collapsible"),
    ("export", "Exports", ""),
    ("comment", "Comments", ""),
    ("decorator", "Decorators", ""),
    ("unknown", "Other", ""),
    ("namespace", "Namespaces", "isolated"),
]
RANK = {k: i + 1 for i, (k, _, _) in enumerate(KINDS)} | {"unknown": 99, "namespace": 100}
HEADER = {k: h for k, h, _ in KINDS}


def _set(flag: str) -> tuple[str, ...]:
    return tuple(k for k, _, flags in KINDS if flag in flags.split())


CALLABLE, VALUE, ELEMENT, ISOLATED = _set("callable"), _set("value"), _set("element"), _set("isolated")
COLLAPSIBLE, FUNCTION_LIKE, HOISTABLE = _set("collapsible"), _set("function"), _set("hoistable")


def eligible(a: str, b: str) -> bool:
    """Whether two kinds may pair at all: isolated ones only with themselves."""
    return a == b or not (a in ISOLATED or b in ISOLATED)


def kind_similarity(a: str, b: str) -> float:
    """1 for the same kind, 0.6 for kinds that turn into one another, else 0.3."""
    if a == b:
        return 1.0
    return 0.6 if any(a in s and b in s for s in (CALLABLE, VALUE, ELEMENT)) else 0.3
