"""A compiler for chat templates: text with ``{{ … }}``, ``{% … %}`` and ``{# … #}``, made into Python closures.

Statements: ``if``/``elif``/``else``, ``for … in``, ``set``, and ``generation`` … ``endgeneration`` around what a model is to
learn. Expressions: literals, lists, names, ``a.b`` and ``a['b']``, ``or and not``, comparisons, ``in``, ``is defined``,
``+``, ``~`` (joins texts) and filters. A minus beside a brace (``{%-``, ``-%}``) drops the white space there.

The language is a sandbox. Values are texts, numbers, truth values, lists, maps and none; a dot is a look-up in a map and
never a Python attribute; there are no calls but the filters listed, no ranges and no recursion. ``messages`` can only be
looped over, once and outside other statements; in that loop ``loop.index``, ``index0``, ``first``, ``last``, ``previtem``
and ``nextitem`` are known. So a conversation is rendered while it streams, whatever its length.
"""

import re
from itertools import chain

_BLOCK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "is", "if", "else", "for"}
#: Statements inside one another, and parts of one expression.
MAX_DEPTH, MAX_LOOPS = 40, 3


class TemplateError(ValueError):
    """The template, or a value that it meets, breaks the rules of the language."""


class Undefined:
    """What a missing key or name gives: empty as text, false as a condition."""

    def __bool__(self):
        return False

    def __eq__(self, other):
        return isinstance(other, Undefined)

    __hash__ = None


UNDEFINED = Undefined()


def text_of(value):
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, Undefined):
        return ""
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} is no text")


def _length(value):
    if not isinstance(value, (str, list, dict)):
        raise TemplateError("only texts, lists and maps have a length")
    return len(value)


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ needs two texts or two numbers")


def _order(compare):
    def checked(a, b):
        if isinstance(a, str) != isinstance(b, str) or not isinstance(a, (str, int)) or not isinstance(b, (str, int)):
            raise TemplateError("only two texts or two numbers have an order")
        return compare(a, b)
    return checked


def _has(a, b):
    if isinstance(b, str):
        return text_of(a) in b
    if isinstance(b, (list, dict)):
        return a in b
    raise TemplateError("in needs a text, a list or a map")


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    return UNDEFINED


#: All operators of two values.
BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _add, "~": lambda a, b: text_of(a) + text_of(b), "in": _has, "item": _item,
          "<": _order(lambda a, b: a < b), "<=": _order(lambda a, b: a <= b), ">": _order(lambda a, b: a > b), ">=": _order(lambda a, b: a >= b)}
#: All functions that a template can call, as filters.
FILTERS = {"trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "length": _length,
           "default": lambda v, other="": other if isinstance(v, Undefined) else v, "capitalize": lambda v: text_of(v).capitalize(),
           "join": lambda v, by="": text_of(by).join(map(text_of, v)) if isinstance(v, list) else text_of(v),
           "replace": lambda v, old, new: text_of(v).replace(text_of(old), text_of(new))}


# --- syntax tree: tuples that begin with their kind ------------------------------------------------------------------


class _Expression:
    """Reads one expression: ('const', v), ('name', n), ('two', op, a, b), ('not', a), ('and', a, b), ('or', a, b),
    ('is', test, a), ('filter', name, a, *arguments), ('list', *items)."""

    def __init__(self, text, known):
        self.text, self.tokens, at, self.depth, self.known = text, [], 0, 0, known
        text = text.rstrip()
        while at < len(text):
            match = _TOKEN.match(text, at)
            if not match:
                raise TemplateError(f"can't read {text[at:at + 20]!r} in {text!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, *values):
        kind, value = self.tokens[self.at]
        return kind != "string" and value in values

    def take(self, *values):
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value):
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.text!r}")

    def name(self):
        kind, value = self.tokens[self.at]
        if kind != "name" or value in _KEYWORDS or value in _WORDS:
            raise TemplateError(f"a name is missing in {self.text!r}")
        self.at += 1
        return value

    def done(self, tree):
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over in {self.text!r}")
        return tree

    def whole(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is nested too deep")
        tree = self._joined("or", lambda: self._joined("and", self._negated))
        self.depth -= 1
        return tree

    def _joined(self, word, part):
        tree = part()
        while self.take(word):
            tree = (word, tree, part())
        return tree

    def _negated(self):
        odd = False
        while self.take("not"):
            odd = not odd
        tree = self._compared()
        return ("not", tree) if odd else tree

    def _compared(self):
        tree = self._sum()
        while True:
            if sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                tree = ("two", sign, tree, self._sum())
            elif self.peek("not") and self.tokens[self.at + 1] == ("name", "in"):
                self.at += 2
                tree = ("not", ("two", "in", tree, self._sum()))
            elif self.take("is"):
                negated, test = self.take("not"), self.tokens[self.at][1]
                if test not in ("defined", "none"):
                    raise TemplateError(f"unknown test {test!r}")
                self.at += 1
                tree = ("not", ("is", test, tree)) if negated else ("is", test, tree)
            else:
                return tree

    def _sum(self):
        tree = self._filtered()
        while sign := self.take("+", "~"):
            tree = ("two", sign, tree, self._filtered())
        return tree

    def _filtered(self):
        tree = self._value()
        while True:
            if self.take("."):
                tree = ("two", "item", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("two", "item", tree, self.whole())
                self.need("]")
            elif self.take("|"):
                name, arguments = self.name(), ()
                if name not in self.known:
                    raise TemplateError(f"unknown filter {name!r}")
                if self.take("("):
                    arguments = self._items(")")
                tree = ("filter", name, tree, *arguments)
            else:
                return tree

    def _items(self, end):
        found = []
        while not self.take(end):
            found.append(self.whole())
            if not self.peek(end):
                self.need(",")
        return tuple(found)

    def _value(self):
        kind, value = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return ("const", int(value))
        if kind == "name" and value in _WORDS:
            self.at += 1
            return ("const", _WORDS[value])
        if self.take("("):
            tree = self.whole()
            self.need(")")
            return tree
        if self.take("["):
            return ("list", *self._items("]"))
        return ("name", self.name())


def parse(source, known=FILTERS):
    """The syntax tree of a template: a list of ('text', t), ('out', e), ('set', name, e), ('if', [(e, body)…], other),
    ('for', name, e, body) and ('generation', body)."""
    pieces, at, trim = [], 0, False
    for match in _BLOCK.finditer(source):
        text = source[at:match.start()]
        text = text.lstrip() if trim else text
        out, statement = match[2], match[5]
        pieces.append(("text", text.rstrip() if match[1] or match[4] else text))
        if out is not None:
            pieces.append(("out", out.strip()))
        elif statement is not None:
            pieces.append(("statement", statement.strip()))
        trim, at = bool(match[3] or match[6]), match.end()
    rest = source[at:]
    if re.search(r"\{\{|\{%|\{#", rest):
        raise TemplateError("a brace is not closed")
    pieces.append(("text", rest.lstrip() if trim else rest))
    body, end = _body(iter(pieces), (), known, 0)
    return body


def _body(pieces, ends, known, depth):
    """The nodes up to one of the ``ends``, and that statement."""
    if depth > MAX_DEPTH:
        raise TemplateError("statements are nested too deep")
    nodes = []
    for kind, text in pieces:
        if kind == "text":
            nodes.append(("text", text))
            continue
        read = _Expression(text, known)
        if kind == "out":
            nodes.append(("out", read.done(read.whole())))
            continue
        word = read.tokens[0][1]
        read.at = 1
        if word in ends:
            return nodes, read
        if word == "if":
            cases, other = [(read.done(read.whole()), None)], []
            while True:
                inner, read = _body(pieces, ("elif", "else", "endif"), known, depth + 1)
                cases[-1] = (cases[-1][0], inner)
                word = read.tokens[0][1]
                if word == "elif":
                    cases.append((read.done(read.whole()), None))
                    continue
                read.done(None)
                if word == "else":
                    other, read = _body(pieces, ("endif",), known, depth + 1)
                    read.done(None)
                break
            nodes.append(("if", cases, other))
        elif word == "for":
            name = read.name()
            read.need("in")
            over = read.done(read.whole())
            inner, read = _body(pieces, ("endfor",), known, depth + 1)
            read.done(None)
            nodes.append(("for", name, over, inner))
        elif word == "set":
            name = read.name()
            read.need("=")
            nodes.append(("set", name, read.done(read.whole())))
        elif word == "generation":
            read.done(None)
            inner, read = _body(pieces, ("endgeneration",), known, depth + 1)
            read.done(None)
            nodes.append(("generation", inner))
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return nodes, None


# --- constant folding ------------------------------------------------------------------------------------------------


def _assigned(nodes):
    """Names that statements give values to."""
    for node in nodes:
        if node[0] == "set":
            yield node[1]
        elif node[0] == "for":
            yield from (node[1], "loop")
            yield from _assigned(node[3])
        elif node[0] == "generation":
            yield from _assigned(node[1])
        elif node[0] == "if":
            for _, body in node[1]:
                yield from _assigned(body)
            yield from _assigned(node[2])


def fold_expression(tree, constants, filters):
    """The expression with its constant parts worked out; ``and`` and ``or`` also go where one side decides."""
    kind = tree[0]
    if kind == "const":
        return tree
    if kind == "name":
        return ("const", constants[tree[1]]) if tree[1] in constants else tree
    head = 2 if kind in ("two", "is", "filter") else 1
    parts = [fold_expression(t, constants, filters) for t in tree[head:]]
    folded = (*tree[:head], *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        return ("const", closure(folded, filters)({}))
    return folded


def fold(nodes, constants, filters):
    """The nodes with constants worked out: branches that are never or always taken go, texts side by side become one."""
    found = []

    def add(node):
        if node[0] == "text" and found and found[-1][0] == "text":
            node = ("text", found.pop()[1] + node[1])
        if node != ("text", ""):
            found.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "out":
            tree = fold_expression(node[1], constants, filters)
            add(("text", text_of(tree[1])) if tree[0] == "const" else ("out", tree))
        elif kind == "set":
            add(("set", node[1], fold_expression(node[2], constants, filters)))
        elif kind == "generation":
            add(("generation", fold(node[1], constants, filters)))
        elif kind == "for":
            over = fold_expression(node[2], constants, filters)
            if over != ("const", []):
                add(("for", node[1], over, fold(node[3], constants, filters)))
        elif kind == "if":
            cases, other = [], node[2]
            for test, body in node[1]:
                test = fold_expression(test, constants, filters)
                if test[0] == "const" and test[1]:
                    other = body
                    break
                if test[0] != "const":
                    cases.append((test, fold(body, constants, filters)))
            other = fold(other, constants, filters)
            if cases:
                add(("if", cases, other))
            else:
                for inner in other:
                    add(inner)
        else:
            add(node)
    return found


# --- closures --------------------------------------------------------------------------------------------------------


def closure(tree, filters):
    """A function from a scope (a dict of names) to the value of the expression."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name, UNDEFINED)
    if kind == "two":
        operate, a, b = BINARY[tree[1]], closure(tree[2], filters), closure(tree[3], filters)
        if tree[3][0] == "const":
            right = tree[3][1]
            return lambda scope: operate(a(scope), right)
        return lambda scope: operate(a(scope), b(scope))
    if kind == "not":
        a = closure(tree[1], filters)
        return lambda scope: not a(scope)
    if kind in ("and", "or"):
        a, b = closure(tree[1], filters), closure(tree[2], filters)
        return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))
    if kind == "is":
        a = closure(tree[2], filters)
        return (lambda scope: not isinstance(a(scope), Undefined)) if tree[1] == "defined" else (lambda scope: a(scope) is None)
    if kind == "list":
        parts = [closure(t, filters) for t in tree[1:]]
        return lambda scope: [p(scope) for p in parts]
    call, parts = filters[tree[1]], [closure(t, filters) for t in tree[2:]]

    def filtered(scope):
        try:
            return call(*[p(scope) for p in parts])
        except TypeError as wrong:
            raise TemplateError(f"{tree[1]}: {wrong}") from None
    return filtered


class Output:
    """What has been rendered: parts, their length, and the spans of generated text."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text):
        self.parts.append(text)
        self.length += len(text)

    def taken(self):
        """Text and spans so far; the output is empty afterwards."""
        piece = "".join(self.parts), self.spans
        self.__init__()
        return piece


def steps(nodes, filters, inside=False, loops=0):
    """A function from (scope, output) that runs the nodes."""
    made = [_step(node, filters, inside, loops) for node in nodes]
    if len(made) == 1:
        return made[0]

    def run(scope, out):
        for step in made:
            step(scope, out)
    return run


def _step(node, filters, inside, loops):
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.write(text)
    if kind == "out":
        value = closure(node[1], filters)
        return lambda scope, out: out.write(text_of(value(scope)))
    if kind == "set":
        name, value = node[1], closure(node[2], filters)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "generation":
        if not inside:
            raise TemplateError("generation stands outside the loop over messages")
        body = steps(node[1], filters, inside, loops)

        def generate(scope, out):
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))
        return generate
    if kind == "if":
        cases, other = [(closure(t, filters), steps(b, filters, inside, loops)) for t, b in node[1]], steps(node[2], filters, inside, loops)

        def choose(scope, out):
            for test, body in cases:
                if test(scope):
                    return body(scope, out)
            return other(scope, out)
        return choose
    if loops == MAX_LOOPS:
        raise TemplateError("loops are nested too deep")
    name, over, body = node[1], closure(node[2], filters), steps(node[3], filters, inside, loops + 1)

    def loop(scope, out):
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("a loop needs a list")
        for place in places(name, items, scope):
            body(place, out)
    return loop


def places(name, items, scope):
    """The scope of each turn of a loop, looking one item ahead. Names set in a turn are gone in the next."""
    before, index = UNDEFINED, 0
    items = iter(items)
    item = next(items, places)
    while item is not places:
        after = next(items, places)
        last = after is places
        yield {**scope, name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": last, "previtem": before,
                                            "nextitem": UNDEFINED if last else after}}
        before, item, index = item, after, index + 1


def _names(tree):
    """Names that an expression reads."""
    if tree[0] == "name":
        yield tree[1]
    for part in tree[1:]:
        if isinstance(part, tuple):
            yield from _names(part)


def _expressions(nodes):
    for node in nodes:
        if node[0] in ("out", "set"):
            yield node[-1]
        elif node[0] == "generation":
            yield from _expressions(node[1])
        elif node[0] == "for":
            yield node[2]
            yield from _expressions(node[3])
        elif node[0] == "if":
            yield from chain.from_iterable([test, *_expressions(body)] for test, body in node[1])
            yield from _expressions(node[2])


class Template:
    """A compiled template. ``constants`` are the names whose values are known now, ``filters`` are added to ``FILTERS``."""

    def __init__(self, source, constants=None, filters=None):
        known = {**FILTERS, **(filters or {})}
        tree = parse(source, known)
        constants = {k: v for k, v in (constants or {}).items() if k not in set(_assigned(tree))}
        self.tree = fold(tree, constants, known)
        loops = [k for k, node in enumerate(self.tree) if node[0] == "for" and node[2] == ("name", "messages")]
        rest = [t for k, node in enumerate(self.tree) for t in (_expressions(node[3]) if k in loops else _expressions([node]))]
        if len(loops) > 1 or any("messages" in _names(t) for t in rest):
            raise TemplateError("messages can be looped over once, outside other statements")
        cut = loops[0] if loops else len(self.tree)
        self._before, self._after = steps(self.tree[:cut], known), steps(self.tree[cut + 1:], known)
        self._name, self._body = (self.tree[cut][1], steps(self.tree[cut][3], known, True, 1)) if loops else ("message", lambda scope, out: None)

    def pieces(self, messages, size=1 << 20):
        """Render an iterable of messages: (text, spans) of one piece after the other, at least one.

        A piece ends with the first message that brings it to ``size`` characters; spans count from the start of their piece.
        """
        scope, out = {}, Output()
        self._before(scope, out)
        for place in places(self._name, messages, scope):
            if out.length >= size:
                yield out.taken()
            self._body(place, out)
        self._after(scope, out)
        yield out.taken()

    def render(self, messages):
        """The whole text and all spans of a conversation."""
        text, spans = "", []
        for piece, inner in self.pieces(messages):
            spans += [(a + len(text), b + len(text)) for a, b in inner]
            text += piece
        return text, spans
