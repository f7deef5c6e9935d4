"""Compile the CSS subset in use: tag, .class, #id, [a], [a='v'], [a*='v'], compounds, descendants."""

import re
from dataclasses import dataclass

_PART = re.compile(
    r"""(?:
        (?P<tag>[A-Za-z][\w-]*|\*)
      | \#(?P<id>(?:\\.|[\w-])+) | \.(?P<cls>(?:\\.|[\w-])+)
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    )""",
    re.X,
)
_ESCAPE = re.compile(r"\\(.)")


@dataclass(frozen=True)
class Compound:
    """Tests one element has to pass."""

    tag: str | None = None
    ident: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str | None, str], ...] = ()


def split_selectors(combined: str) -> list[str]:
    """Comma-split, trimmed, empties dropped; alternatives are tried left to right."""
    return [part.strip() for part in combined.split(",") if part.strip()]


def compile_selector(selector: str) -> list[Compound]:
    """'form[data-sku] .price' -> compounds, outermost first."""
    return [_compile_compound(word, selector) for word in _words(selector)]


def _words(selector: str) -> list[str]:
    return re.findall(r"(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*\]|\\.|\S)+", selector)


def _compile_compound(word: str, selector: str) -> Compound:
    tag = ident = None
    classes, attrs, pos = [], [], 0
    while pos < len(word):
        m = _PART.match(word, pos)
        if m is None:
            raise ValueError(f"unsupported selector {selector!r} at {word[pos:]!r}")
        pos = m.end()
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            ident = _ESCAPE.sub(r"\1", m["id"])
        elif m["cls"]:
            classes.append(_ESCAPE.sub(r"\1", m["cls"]))
        else:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
            attrs.append((m["attr"].lower(), m["op"], value))
    return Compound(tag, ident, tuple(classes), tuple(attrs))
