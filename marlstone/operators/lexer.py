"""Symbols, calls and bases of languages with braces, from one reading of their tokens.

Strings and comments are read as such, so braces and names in them count for nothing. A stack of scopes
is kept: what stands before an opening brace says whether it begins a class, a function or a block,
and the closing one where it ends. A call belongs to the innermost function that it stands in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

LANGUAGES = set("java javascript typescript go csharp php rust c cpp kotlin scala swift".split())
_LINE_COMMENT = {"php": r"//[^\n]*|\#(?!\[)[^\n]*"}
_DIRECTIVES = {"c", "cpp", "csharp"}
_CLASS = set("class interface enum struct trait record union object protocol impl extension".split())
_PLAIN = {"namespace", "module", "package", "extern"}
_FUNCTION = {"go": "func", "rust": "fn", "php": "function", "javascript": "function", "typescript": "function", "kotlin": "fun", "scala": "def", "swift": "func"}
_NO_CALL = set(
    "if for while switch catch return function fn func fun def else do try finally new throw typeof instanceof in of case sizeof foreach using lock match "
    "loop when where yield await delete void unless elseif guard with synchronized super this extends implements class isset empty list array echo "
    "print require include require_once include_once assert base sizeof alignof decltype static_assert fixed checked unchecked nameof default".split()
)
_CONTROL = set("if for while switch catch return else do try finally new throw case foreach using lock match loop when yield await delete synchronized".split())
_BRANCH = set("if for foreach while case catch when elseif unless guard && || ?".split())
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || return typeof case in of delete void throw new else do".split()) | {""}
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]+")


@dataclass(slots=True)
class Token:
    text: str
    line: int
    name: bool = False


def _lexer(language: str) -> re.Pattern:
    comment = _LINE_COMMENT.get(language, r"//[^\n]*")
    parts = [rf"(?P<comment>{comment}|/\*.*?(?:\*/|\Z))"]
    if language in _DIRECTIVES:
        parts.append(r"(?P<directive>^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)")
    if language in ("java", "csharp", "kotlin", "scala", "swift"):
        parts.append(r'(?P<block>""".*?(?:"""|\Z))')
    if language == "csharp":
        parts.append(r'(?P<verbatim>\$?@\$?"(?:[^"]|"")*")')
    if language == "cpp":
        parts.append(r'(?P<raw>R"(?P<mark>[^(\s]*)\(.*?\)(?P=mark)")')
    if language == "rust":
        parts.append(r"(?P<rawrust>r(?P<hashes>\#*)\".*?\"(?P=hashes))|(?P<life>'[^\W\d]\w*(?!'))")
    if language == "go":
        parts.append(r"(?P<quoted>`[^`]*`)")
    parts.append(r'(?P<string>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')' if language != "php" else r'(?P<string>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')')
    parts.append(r"(?P<name>[^\W\d][\w$]*|\$[\w$]+)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<mark2>=>|->|::|&&|\|\||\?\.|\?\?|\?->)|(?P<other>.)")
    return re.compile(f"(?:{'|'.join(parts)})\\s*", re.S | re.M)


_LEXERS = {x: _lexer(x) for x in LANGUAGES}
_MARKS = {"other", "mark2", "number"}
_STRINGS = {"string", "block", "verbatim", "raw", "mark", "rawrust", "hashes", "quoted"}
#: A line from its first token on in which nothing can begin that goes on after it or depends on what was before: no text, comment, pattern or directive.
_PLAIN_LINE = re.compile(r"([^/\"'`#\\\n]{1,120})(?:\n\s*|\Z)")
#: Lines and heads of blocks that a worker remembers, and tokens of such a head at most: code says the same again and again.
REMEMBERED, HEAD_TOKENS = 4096, 40
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _template(code: str, at: int) -> int:
    """Where a template string ends, whose holes may hold other ones."""
    at += 1
    while at < len(code):
        c = code[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif code.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(code) and depth:
                if code[at] == "`":
                    at = _template(code, at)
                    continue
                depth += {"{": 1, "}": -1}.get(code[at], 0)
                at += 1
        else:
            at += 1
    return at


@lru_cache(REMEMBERED)
def _line(text: str, language: str) -> tuple[tuple[str, bool], ...]:
    """The tokens of a line as _PLAIN_LINE finds it."""
    found = ((m.lastgroup, m) for m in _LEXERS[language].finditer(text))
    return tuple((m[kind], kind == "name") for kind, m in found if kind == "name" or kind in _MARKS)


def tokens(code: str, language: str) -> tuple[list[Token], dict[int, str]]:
    """Names and marks with their lines, and the text of the comment that ends on a line."""
    lexer, script = _LEXERS[language], language in ("javascript", "typescript")
    out, comments, at, line = [], {}, 0, 1
    if language == "php" and (start := code.find("<?")) >= 0:
        at = start + (5 if code.startswith("<?php", start) else 2)
        line += code.count("\n", 0, at)
    match, size, put, count, plain = lexer.match, len(code), out.append, code.count, _PLAIN_LINE.match
    begins = True  # whether a line's first token is next
    while at < size:
        if begins and (m := plain(code, at)):
            for text, name in _line(m[1], language):
                put(Token(text, line, name))
            end = m.end()
            line += count("\n", at, end)
            at = end
            continue
        if script and code[at] == "`":
            end = _template(code, at)
            out.append(Token('""', line))
        elif script and code[at] == "/" and (out[-1].text if out else "") in _BEFORE_REGEX and (m := _REGEX.match(code, at)):
            end = m.end()
            out.append(Token('""', line))
        else:
            m = match(code, at)  # with the space that follows
            end, kind = m.end(), m.lastgroup
            if kind == "name":
                put(Token(m[kind], line, True))
            elif kind in _MARKS:
                put(Token(m[kind], line))
            elif kind in _STRINGS:
                put(Token('""', line))
            elif kind == "comment":
                found = m[kind]
                text = re.sub(r"(?m)^\s*(?:/\*+|//+|\#|\*+(?!/))?[ \t]?|\s*\*+/\s*\Z", "", found).strip()
                last = line + found.count("\n")
                before = comments.pop(last - 1, "") if found[:2] != "/*" else ""
                comments[last] = f"{before}\n{text}".strip()
        before, line = line, line + count("\n", at, end)
        begins = line > before and code[end - 1 : end].isspace()
        at = end
    return out, comments


@dataclass(slots=True)
class Scope:
    kind: str  # class, function or block
    name: str = ""
    line: int = 0
    branches: int = 0
    methods: int = 0
    bases: list[str] = field(default_factory=list)
    qualified: str = ""
    signature: str = ""
    doc: str | None = None
    method: bool = False
    depth: int = -1  # of brackets, for functions without braces


@dataclass
class Found:
    """Rows as ``code.SYMBOLS``, ``code.CALLS`` and ``code.INHERITS`` name them."""

    symbols: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    bases: list[tuple] = field(default_factory=list)


def _dotted(words: list[Token], at: int) -> str:
    """The name that ends at a place, with what it is a member of."""
    out = [words[at].text]
    while at >= 2 and words[at - 1].text in (".", "->", "::", "?.", "?->") and words[at - 2].name:
        at -= 2
        out.append(words[at].text)
    return ".".join(x.lstrip("$") for x in reversed(out))


def _flat(head: list[Token]) -> list[int]:
    """Places of the tokens of a head that stand in no brackets."""
    out, depth = [], 0
    for i, t in enumerate(head):
        if t.text in ("(", "["):
            out += [i] if not depth else []
            depth += 1
        elif t.text in (")", "]"):
            depth -= 1
        elif not depth:
            out.append(i)
    return out


def _class_head(head: list[Token], flat: list[int], language: str) -> Scope | None:
    for place, i in enumerate(flat):
        word = head[i].text
        if language == "go" and word in ("struct", "interface") and place >= 2 and head[flat[place - 2]].text == "type":
            name = head[flat[place - 1]]
            return Scope("class", name.text, name.line)
        if word not in _CLASS or (language == "go") or (place and head[flat[place - 1]].text in (".", "::")):
            continue
        rest = [head[j] for j in flat[place + 1 :]]
        if word == "impl":
            plain, depth = [], 0
            for t in rest:
                depth += {"<": 1, ">": -1}.get(t.text, 0)
                if not depth and t.text != ">":
                    plain.append(t)
            names = [t for t in plain if t.name]
            cut = next((k for k, t in enumerate(names) if t.text == "for"), None)
            if not names:
                return None
            own = names[cut + 1] if cut is not None and cut + 1 < len(names) else names[0]
            bases = [names[cut - 1].text] if cut else []
            return Scope("impl", own.text, own.line, bases=bases)
        names = [t for t in rest if t.name and t.text not in _CLASS]
        if not names:
            return Scope("block") if word != "class" else Scope("class", "", head[i].line)
        if names[0].text in ("extends", "implements"):
            return Scope("class", "", head[i].line, bases=_bases(rest))
        return Scope("class", names[0].text, names[0].line, bases=_bases(rest[1:]))
    return None


def _bases(rest: list[Token]) -> list[str]:
    """Names after extends, implements or a colon, without what stands in angle brackets."""
    out, depth, on, now = [], 0, False, ""
    for t in [*rest, Token(",", 0)]:
        if t.text in ("<", ">"):
            depth += 1 if t.text == "<" else -1
        elif depth > 0:
            continue
        elif t.text in ("permits", "where"):
            return [x.strip(".") for x in [*out, now] if x.strip(".")]
        elif t.text in ("extends", "implements", ":", "with", ","):
            if on and now:
                out.append(now)
            on, now = on or t.text != ",", ""
        elif on and t.name and t.text not in ("public", "private", "protected", "virtual"):
            now += t.text
        elif on and t.text in (".", "::", "\\"):
            now += "."
    return [x.strip(".") for x in out if x.strip(".")]


def _function_head(head: list[Token], flat: list[int], language: str, in_class: bool) -> tuple[Token, str] | None:
    """The name token of a function that a head declares and, in Go, the type that it is a method of."""
    words = [head[i].text for i in flat]
    script = language in ("javascript", "typescript")
    mark = _FUNCTION.get(language)
    if mark and mark in words:
        place = words.index(mark)
        after = flat[place + 1] if place + 1 < len(flat) else None
        if language == "go" and after is not None and head[after].text == "(":
            receiver = [t for t in head[after + 1 : flat[place + 2] if place + 2 < len(flat) else None] if t.name]
            named = next((head[i] for i in flat[place + 2 :] if head[i].name), None)
            return (named, receiver[-1].text if receiver else "") if named else None
        named = next((head[i] for i in flat[place + 1 : place + 3] if head[i].name), None)
        if named is not None:
            return named, ""
        if not script and language != "php":
            return None
    opening = next((i for i in flat if head[i].text == "("), None)
    if script:
        for place, i in enumerate(flat):  # name = (..) =>, name = function, name: function
            if head[i].text in ("=", ":") and place and head[flat[place - 1]].name and ("=>" in words[place:] or "function" in words[place:]):
                return head[flat[place - 1]], ""
        if "=>" in words or "function" in words or not in_class:
            return None
    if opening is None or opening == 0 or mark and not script:
        return None
    at = opening - 1
    if head[at].text == ">":  # type parameters
        depth = 0
        while at >= 0:
            depth += {">": 1, "<": -1}.get(head[at].text, 0)
            at -= 1
            if not depth:
                break
    if at < 0 or not head[at].name or head[at].text in _NO_CALL:
        return None
    first = head[flat[0]].text
    if first in _CONTROL or (not in_class and at == 0 and not script) or "=" in words[: flat.index(opening)]:
        return None
    if not in_class and not script and head[at - 1].text in (".", "->", "return"):
        return None
    return head[at], head[at - 2].text if at >= 2 and head[at - 1].text == "::" else ""


def _opening(texts: tuple[str, ...], language: str, in_class: bool, top: bool) -> tuple[Scope | None, int, str]:
    """What a head before a brace begins, by the texts of its tokens: a class or impl (its line is a place in the head), else the place of a function's name (-1: a block) and its type."""
    head = [Token(x, i, bool(_NAME.match(x))) for i, x in enumerate(texts)]
    flat = _flat(head)
    scope = _class_head(head, flat, language) if top else None
    if scope is not None and scope.kind in ("class", "impl") and scope.name:
        return scope, -1, ""
    plain = flat and head[flat[0]].text in _PLAIN
    declares = None if plain else _function_head(head, flat, language, in_class)
    return (None, declares[0].line, declares[1]) if declares else (None, -1, "")


_remembered = lru_cache(REMEMBERED)(_opening)
#: Marks and words at which ``read`` does more than to go on.
_ROLES = _BRANCH | set("{ } ( [ ) ] ; =>".split())


def read(code: str, language: str) -> Found:
    """Symbols, calls and bases of a file in a language of LANGUAGES."""
    words, comments = tokens(code, language)
    lines = code.split("\n")
    found = Found()
    stack: list[Scope] = [Scope("module")]
    head: list[Token] = []
    pending: list[tuple[Token, str]] = []  # calls of the head so far
    waiting: list[Scope] = []  # functions without braces
    round_ = 0
    heads: list[tuple] = []

    def names(kinds=("class", "impl", "function")) -> list[str]:
        return [s.name for s in stack if s.kind in kinds and s.name]

    def flush() -> None:
        if not pending:
            return
        owner = next((s.qualified for s in reversed(stack) if s.kind == "function"), "<module>")
        found.calls.extend((owner, callee, t.line) for t, callee in pending)
        pending.clear()

    def declared(scope: Scope, named: Token) -> Scope:
        first = next((t for t in head if t.line), named)
        scope.signature = lines[named.line - 1].strip().rstrip("{").strip()
        scope.doc = comments.get(first.line - 1) or None
        return scope

    def begun(scope: Scope, named: Token, of: str) -> Scope:
        above = [of] if of else names(("class", "impl"))
        scope.method = bool(of) or stack[-1].kind in ("class", "impl")
        scope.qualified = ".".join([*(above if scope.method else names()), scope.name])
        if stack[-1].kind == "class":
            stack[-1].methods += 1
        return declared(scope, named)

    def ended(scope: Scope, line: int) -> None:
        if scope.kind == "class" and scope.name:
            found.symbols.append(("class", scope.name, scope.qualified, scope.line, line, scope.signature, scope.doc, 1 + scope.branches, scope.methods))
        elif scope.kind == "function" and scope.name:
            kind = "method" if scope.method else "function"
            found.symbols.append((kind, scope.name, scope.qualified, scope.line, line, scope.signature, scope.doc, 1 + scope.branches, 0))

    def close_waiting(line: int, depth: int) -> None:
        while stack[-1].depth >= 0 and stack[-1].depth >= depth:
            flush()
            ended(stack.pop(), line)

    by_line = language in ("go", "javascript", "typescript", "kotlin", "swift", "scala")
    arrows = language in ("javascript", "typescript", "csharp")
    n_words = len(words)
    for i, t in enumerate(words):
        x = t.text
        if x not in _ROLES:
            if by_line and not round_ and head and t.line > head[-1].line and not _goes_on(head[-1].text, x, language):
                pending = _embedded(found, stack[-1], head, language, pending)
                if pending:
                    flush()
                close_waiting(head[-1].line, 0)
                head = []
            head.append(t)
            if t.name and i + 1 < n_words and words[i + 1].text == "(" and x not in _NO_CALL:
                pending.append((t, _dotted(words, i)))
            continue
        if x == "{":
            texts = tuple([h.text for h in head])
            opened, place, of = (_remembered if len(texts) <= HEAD_TOKENS else _opening)(texts, language, stack[-1].kind in ("class", "impl"), round_ == 0)
            if opened is not None:
                scope = Scope(opened.kind, opened.name, head[opened.line].line, bases=opened.bases)
                scope.qualified = ".".join([*names(), scope.name]) if scope.kind == "class" else scope.name
                declared(scope, Token(scope.name, scope.line))
                found.bases += [(scope.qualified, b, scope.line) for b in scope.bases]
                flush()
            else:
                scope = Scope("block")
                if place >= 0:
                    named = head[place]
                    scope = begun(Scope("function", named.text, named.line), named, of)
                    pending = [p for p in pending if p[0] is not named]
                if pending and scope.kind == "function":
                    stack.append(scope)
                    flush()
                    stack.pop()
                elif pending:
                    flush()
            heads.append((head, round_))
            stack.append(scope)
            head, round_ = [], 0
            continue
        if x == "}":
            if head:
                pending = _embedded(found, stack[-1], head, language, pending)
            if pending:
                flush()
            if stack[-1].depth >= 0:
                close_waiting(t.line, 0)
            if len(stack) > 1:
                scope = stack.pop()
                ended(scope, t.line)
                head, round_ = heads.pop() if heads else ([], 0)
                # a literal or a function in brackets goes on with its statement; others begin a new one
                if not round_ and not (head and head[-1].text in ("=", "return", ":", ",", "=>")):
                    head = []
            close_waiting(t.line, 1) if not round_ and not head else None
            continue
        if x in "([":
            round_ += 1
        elif x in ")]":
            close_waiting(t.line, round_) if stack[-1].depth > 0 else None
            round_ = max(0, round_ - 1)
        ends = x == ";" and not round_
        line_ends = by_line and not round_ and head and t.line > head[-1].line and not _goes_on(head[-1].text, x, language)
        if ends or line_ends:
            pending = _embedded(found, stack[-1], head, language, pending)
            if pending:
                flush()
            close_waiting(head[-1].line if head else t.line, 0)
            head = []
            if ends:
                continue
        head.append(t)
        if x in _BRANCH and not (x == "?" and (i == 0 or words[i - 1].text in (":", "(", ",") or (i + 1 < n_words and words[i + 1].text in (":", ")", ",", "=", ">", ";")))):
            owner = next((s for s in reversed(stack) if s.kind in ("function", "class")), stack[0])
            owner.branches += 1
        if t.name and i + 1 < n_words and words[i + 1].text == "(" and x not in _NO_CALL:
            pending.append((t, _dotted(words, i)))
        if x == "=>" and arrows and i + 1 < n_words and words[i + 1].text != "{":
            declares = _function_head(head, _flat(head), language, stack[-1].kind in ("class", "impl")) if not round_ else None
            if declares:
                named, of = declares
                pending = [p for p in pending if p[0] is not named]
                flush()
                scope = begun(Scope("function", named.text, named.line, depth=round_), named, of)
                stack.append(scope)
    flush()
    last = len(lines) if lines[-1].strip() else max(1, len(lines) - 1)
    while len(stack) > 1:
        ended(stack.pop(), last)
    found.symbols.sort(key=lambda s: (s[3], -s[4], s[0] != "class"))
    found.calls.sort(key=lambda c: c[2])
    return found


# Marks and words at a line's end or beginning after which, or before which, a statement goes on.
_OPEN = set("= + - * / % , . ( [ & | && || => -> :: < ? : ?. ?? ! extends implements return const let var async func type".split())
_LEADING = set(". ?. && || + - * / ? : => = , ) ] { ??".split())


def _goes_on(before: str, now: str, language: str) -> bool:
    """Whether a line break between two tokens is no end of a statement, in languages where it mostly is."""
    return before in _OPEN or (language != "go" and now in _LEADING)


def _embedded(found: Found, scope: Scope, head: list[Token], language: str, pending: list) -> list:
    """What a statement of a class declares: a method without a body is no call; in Go a type alone is a base."""
    if scope.kind not in ("class", "impl") or not head:
        return pending
    if language == "go":
        names, marks = [t.text for t in head if t.name], [t.text for t in head if not t.name and t.text != '""']
        if len(names) == 1 + marks.count(".") and marks in ([], ["*"], ["."], ["*", "."]):
            found.bases.append((scope.qualified, ".".join(names), head[0].line))
        return []
    declares = _function_head(head, _flat(head), language, True)
    return [p for p in pending if not declares or p[0] is not declares[0]]
