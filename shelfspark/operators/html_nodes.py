"""Per-page helper: one tokenizer pass that records the nodes matched by compiled selectors.

It keeps a stack of open elements only, not a document tree. Deliberate limits: formatting
elements are not reopened after a mis-nested close, out-of-place table content is not moved, and a
tag with a bare '<' outside quotes is text. Every attempt at a tag ends at the next such '<', and open
elements are found by name, so the time is linear in the page whatever it holds.
"""

import re
from html import unescape

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<start>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>]*+))*+)>"
    r"|</(?P<end>[a-zA-Z][^\s/<>]*+)[^<>]*+>"
    r"|<[!?/][^<>]*+>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

# Fixed values of the HTML syntax.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW_TEXT = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in "script style textarea title iframe noembed noframes xmp".split()
}
_ENTITIES_IN_RAW = frozenset(("textarea", "title"))
_SPECIAL = frozenset(
    "address article aside blockquote body button caption center dd details dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header html li main menu nav ol p pre section select summary "
    "table tbody td template tfoot th thead tr ul".split()
)
_SCOPE = frozenset("caption html table td template th".split())
_TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
_CLOSES_P = _SPECIAL - frozenset("body button caption head html select tbody td template tfoot th thead tr".split()) | {"hr"}
# start tag -> (open elements it closes, elements that stop the search)
_IMPLIED_CLOSE = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split()) | _SCOPE),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"]) | _SCOPE),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"]) | _SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_TABLE_ONLY = frozenset(["table"])
_P = frozenset(["p"])
_P_SCOPE = _SCOPE | {"button"}


class SelectorIndex:
    """All steps of all selectors, filed under the tag, class, id or attribute they need most.

    A step is (needs, sets, hit, compound): `needs` is the bit of the previous compound that must
    hold for an ancestor, `sets` the bit it gives to descendants, `hit` the (field, alternative) it completes.
    """

    CACHED_TAGS, CACHED_LENGTH = 2_000, 300

    def __init__(self, alternatives):
        self.by_tag, self.by_class, self.by_id, self.by_attr = {}, {}, {}, {}
        self.known = {}
        bit = 1
        for field, alt, compounds in alternatives:
            needs = 0
            for i, c in enumerate(compounds):
                last = i == len(compounds) - 1
                step = (needs, 0 if last else bit, (field, alt) if last else None, c)
                if c.ident:
                    self.by_id.setdefault(c.ident, []).append(step)
                elif c.classes:
                    self.by_class.setdefault(c.classes[0], []).append(step)
                elif c.attrs:
                    self.by_attr.setdefault(c.attrs[0][0], []).append(step)
                else:
                    self.by_tag.setdefault(c.tag or "*", []).append(step)
                needs, bit = bit, bit << 1

    def start_tag(self, text, name, source):
        """Everything about a start tag that does not depend on its ancestors; pages repeat tags, so keep it.

        (name, attributes, steps whose compound passes, void, closes p, implied close, table part, raw text end)
        """
        name = name.lower()
        attrs = _attributes(source) if source and source != "/" else {}
        classes = (attrs.get("class") or "").split()
        steps = [*self.by_tag.get(name, ()), *self.by_tag.get("*", ()), *self.by_id.get(attrs.get("id"), ())]
        for css_class in dict.fromkeys(classes):
            steps += self.by_class.get(css_class, ())
        for attr in attrs:
            steps += self.by_attr.get(attr, ())
        passed = [(needs, sets, hit) for needs, sets, hit, c in steps if _passes(c, name, attrs, classes)]
        passed.sort(key=lambda step: step[2] or (-1, -1))
        tag = (name, attrs, passed, name in _VOID, name in _CLOSES_P, _IMPLIED_CLOSE.get(name),
               name in _TABLE_PARTS, _RAW_TEXT.get(name))
        if len(self.known) >= self.CACHED_TAGS:
            self.known.clear()
        if len(text) <= self.CACHED_LENGTH:
            self.known[text] = tag
        return tag


def _passes(c, tag, attrs, classes):
    if c.tag and c.tag != tag:
        return False
    if c.ident and attrs.get("id") != c.ident:
        return False
    if any(name not in classes for name in c.classes):
        return False
    for name, op, wanted in c.attrs:
        if name not in attrs:
            return False
        value = attrs[name] or ""
        if op == "=" and value != wanted:
            return False
        if op == "*=" and not (wanted and wanted in value):
            return False
        if op == "^=" and not (wanted and value.startswith(wanted)):
            return False
        if op == "$=" and not (wanted and value.endswith(wanted)):
            return False
    return True


def _attributes(source):
    found = {}
    for name, dq, sq, bare in _ATTR.findall(source):
        value = dq or sq or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def match_page(html, index, fields):
    """One list of hit records per field: [alternative, text, attribute values, cell texts], in selector order.

    `fields` holds (number of alternatives, wants text, attribute names, wants cells, first only, as group).
    """
    hits = [[[] for _ in range(f[0])] for f in fields]
    stack = []          # (tag, bits held below, [(record, cell number or -1, first fragment)])
    fragments = []      # stripped text runs, kept only while some open node wants text
    pending = []        # pieces of the current text run
    open_texts = 0      # open nodes whose text is wanted
    open_rows = []      # open spec rows that still collect cells
    depths = {}         # tag -> its places in the stack
    special_depths = []

    def end_run():
        run = "".join(pending)
        pending.clear()
        run = (unescape(run) if "&" in run else run).strip()
        if run:
            fragments.append(run)

    def close_to(depth):
        nonlocal open_texts
        if pending:
            end_run()
        while len(stack) > depth:
            name, _, wanted = stack.pop()
            depths[name].pop()
            if name in _SPECIAL:
                special_depths.pop()
            if wanted:
                open_texts -= len(wanted)
                for record, cell, start in wanted:
                    if cell >= 0:
                        record[3][cell] = "".join(fragments[start:])
                    elif record[1] is None:
                        record[1] = "".join(fragments[start:])
                    else:
                        open_rows.pop()
                if not open_texts:
                    fragments.clear()

    def find_open(names, barrier):
        """Place of the innermost open element of `names`, unless one of `barrier` stands further in."""
        found = max((depths[n][-1] for n in names if depths.get(n)), default=-1)
        if found < 0:
            return -1
        if barrier is _SPECIAL:
            wall = special_depths[-1] if special_depths else -1
        else:
            wall = max((depths[n][-1] for n in barrier if depths.get(n)), default=-1)
        return found if found >= wall else -1

    pos, size = 0, len(html)
    scan, known = _TOKEN.search, index.known
    while pos < size:
        m = scan(html, pos)
        if m is None:
            if open_texts:
                pending.append(html[pos:])
            break
        start, stop = m.span()
        if open_texts and start > pos:
            pending.append(html[pos:start])
        pos = stop

        kind = m.lastindex
        if kind == 3:
            name = m[3].lower()
            if stack and stack[-1][0] == name:
                close_to(len(stack) - 1)
                continue
            if name in _SPECIAL:
                barrier = _TABLE_ONLY if name in _TABLE_PARTS else () if name == "table" else _SCOPE
            else:
                barrier = _SPECIAL
            depth = find_open((name,), barrier)
            if depth >= 0:
                close_to(depth)
            continue
        if kind is None:
            if pending:
                end_run()
            continue

        text = m[0]
        tag = known.get(text) or index.start_tag(text, m[1], m[2])
        name, attrs, steps, void, closes_p, implied, table_part, raw_end = tag
        if table_part and not depths.get("table"):
            continue
        if pending:
            end_run()
        if closes_p and depths.get("p"):
            depth = find_open(_P, _P_SCOPE)
            if depth >= 0:
                close_to(depth)
        if implied:
            depth = find_open(*implied)
            if depth >= 0:
                close_to(depth)

        held = bits = stack[-1][1] if stack else 0
        wanted = []
        if steps:
            last_group = -1
            for needs, sets, hit in steps:
                if needs and not held & needs:
                    continue
                bits |= sets
                if not hit:
                    continue
                field, alt = hit
                _, wants_text, attr_names, wants_cells, first_only, as_group = fields[field]
                if as_group:
                    if field == last_group:
                        continue
                    last_group = field
                if first_only and hits[field][alt]:
                    continue
                record = [alt, None if wants_text else "", [attrs.get(a) for a in attr_names], []]
                hits[field][alt].append(record)
                if wants_text or wants_cells:
                    wanted.append((record, -1, len(fragments)))
        if open_rows and (name == "td" or name == "th"):
            for record in open_rows:
                if len(record[3]) < 2:
                    record[3].append("")
                    wanted.append((record, len(record[3]) - 1, len(fragments)))

        if void:
            for record, cell, _ in wanted:
                if cell < 0:
                    record[1] = ""
            continue
        if wanted:
            open_texts += len(wanted)
            open_rows += [record for record, cell, _ in wanted if cell < 0 and record[1] is not None]
        depths.setdefault(name, []).append(len(stack))
        if name in _SPECIAL:
            special_depths.append(len(stack))
        stack.append((name, bits, wanted))
        if raw_end:
            end = raw_end.search(html, pos)
            stop = end.start() if end else size
            if open_texts and stop > pos:
                raw = html[pos:stop]
                raw = (unescape(raw) if name in _ENTITIES_IN_RAW else raw).strip()
                if raw:
                    fragments.append(raw)
            pos = stop
    close_to(0)
    return [[record for alt in field for record in alt] for field in hits]
