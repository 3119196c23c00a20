"""Pattern dialects, translated once on the driver into regexes for the JVM and for the position finder.

The JVM side decides whether a line or text matches; the finder (the ``regex`` module, leftmost-longest
where the dialect asks for it) gives places and captures.
"""

from __future__ import annotations

import re
import warnings
from re import _parser
from dataclasses import dataclass, field

from ..model import SearchOptions

_POSIX = {
    "alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "punct": r"!-/:-@\[-`{-~", "space": r" \t\x0B\f\r", "blank": r" \t",
    "cntrl": r"\x00-\x1F\x7F", "graph": r"!-~", "print": r" -~", "xdigit": r"0-9A-Fa-f", "word": r"\p{L}\p{Nd}_", "ascii": r"\x00-\x7F",
}
_POSIX_ASCII = _POSIX | {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "word": "A-Za-z0-9_"}
#: What stands for a class escape inside and outside brackets; the first is for the JVM, the second for ``regex``.
_SPACE_IN = r" \t\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_BLANK_IN = r" \t\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
#: Binary property names that both engines know as they are.
_CATEGORIES = re.compile(r"^(L[lutmo&]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfons]?)$")
_PROPERTY = {
    "Space": f"[{_SPACE_IN}]", "Word": r"[\p{L}\p{Nd}_]", "Alpha": r"\p{L}", "Alnum": r"[\p{L}\p{Nd}]", "Digit": r"\p{Nd}", "Upper": r"\p{Lu}", "Lower": r"\p{Ll}", "Punct": r"[!-/:-@\[-`{-~]",
    "Blank": r"[ \t]", "Cntrl": r"[\x00-\x1F\x7F]", "Graph": "[!-~]", "Print": "[ -~]", "XDigit": "[0-9A-Fa-f]", "ASCII": r"[\x00-\x7F]", "Any": r"[\s\S]", "Unicode": r"[\s\S]",
    "Letter": r"\p{L}", "Number": r"\p{N}", "Lowercase_Letter": r"\p{Ll}", "Uppercase_Letter": r"\p{Lu}", "Punctuation": r"\p{P}", "Symbol": r"\p{S}", "Separator": r"\p{Z}",
}


class PatternError(ValueError):
    """The pattern isn't well formed in its dialect."""


def bre_to_ere(p: str) -> str:
    """Basic syntax: ``\\( \\) \\{ \\} \\| \\+ \\?`` are operators and the bare characters are literal."""
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            d = p[i + 1]
            out.append(d if d in "(){}|+?" else c + d)
            i += 2
            continue
        if c == "[":
            j = _class_end(p, i)
            out.append(p[i:j])
            i = j
            continue
        if c in "(){}|+?":
            out.append("\\" + c)
        elif c == "*" and (not out or out[-1] in ("(", "|") or (out[-1] == "^" and len(out) == 1)):
            out.append("\\*")  # nothing to repeat
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _class_end(p: str, i: int) -> int:
    """Index after the bracket expression that starts at ``i``."""
    j = i + 1
    if j < len(p) and p[j] == "^":
        j += 1
    if j < len(p) and p[j] == "]":
        j += 1
    while j < len(p):
        if p[j] == "\\":
            j += 2
        elif p.startswith("[:", j) and ":]" in p[j:]:
            j = p.index(":]", j) + 2
        elif p[j] == "[" and p[j - 2 : j] in ("--", "&&", "||"):
            j = _class_end(p, j)
        elif p[j] == "]":
            return j + 1
        else:
            j += 1
    raise PatternError(f"missing ] in {p!r}")


@dataclass
class Translated:
    jvm: str = ""
    finder: str = ""


@dataclass
class _Out:
    ascii: bool
    fold: bool
    parts: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    def add(self, jvm: str, finder: str | None = None) -> None:
        self.parts.append(jvm)
        self.other.append(jvm if finder is None else finder)


def _property(name: str, negated: bool) -> tuple[str, str]:
    if name.startswith("^"):
        name, negated = name[1:], not negated
    if _CATEGORIES.match(name):
        p = ("\\P{" if negated else "\\p{") + name + "}"
        return p, p
    if name in _PROPERTY:
        inner = _PROPERTY[name]
        if not negated:
            return inner, inner
        if inner.startswith("["):
            return "[^\\n" + inner[1:], "[^\\n" + inner[1:]
        return inner.replace("\\p", "\\P", 1), inner.replace("\\p", "\\P", 1)
    sign = "P" if negated else "p"
    if name.startswith("Is"):  # a block
        block = name[2:]
        return f"\\{sign}{{In{block}}}", f"\\{sign}{{Block={block}}}"
    return f"\\{sign}{{Is{name}}}", f"\\{sign}{{Script={name}}}"


def _escape(p: str, i: int, ascii_: bool, inside: bool) -> tuple[str, str, int]:
    """(JVM, finder, next index) of the escape at ``i``."""
    c = p[i + 1] if i + 1 < len(p) else None
    if c is None:
        raise PatternError(f"trailing \\ in {p!r}")
    n = i + 2
    both = lambda s: (s, s, n)
    if c in "pP" and n < len(p):
        if p[n] == "{":
            e = p.find("}", n)
            if e < 0:
                raise PatternError(f"missing }} in {p!r}")
            a, b = _property(p[n + 1 : e], c == "P")
            return a, b, e + 1
        a, b = _property(p[n], c == "P")
        return a, b, n + 1
    for lead, base in (("x", 16), ("u", 16), ("o", 8)):
        if c == lead and n < len(p) and p[n] == "{":
            e = p.find("}", n)
            code = int(p[n + 1 : e], base)
            return f"\\x{{{code:X}}}", re.escape(chr(code)) if not inside else f"\\U{code:08X}", e + 1
    if c == "x":
        m = re.compile("[0-9A-Fa-f]{1,2}").match(p, n)
        if not m:
            raise PatternError(f"bad \\x in {p!r}")
        code = int(m[0], 16)
        return f"\\x{code:02X}", f"\\x{code:02X}", m.end()
    if c == "u" and (m := re.compile("[0-9A-Fa-f]{4}").match(p, n)):
        return f"\\u{m[0]}", f"\\u{m[0]}", m.end()
    if c == "0":
        m = re.compile("[0-7]{0,3}").match(p, n)
        code = int(m[0] or "0", 8)
        return f"\\x{code:02X}", f"\\x{code:02X}", m.end()
    if c == "c" and n < len(p):
        code = ord(p[n].upper()) ^ 64
        return f"\\x{code:02X}", f"\\x{code:02X}", n + 1
    word, digit = ("A-Za-z0-9_", "0-9") if ascii_ else (r"\p{L}\p{M}\p{Nd}\p{Pc}", r"\p{Nd}")
    classes = {"w": word, "d": digit, "s": r" \t\x0B\f\r" if ascii_ else _SPACE_IN, "h": r" \t" if ascii_ else _BLANK_IN, "l": "a-z" if ascii_ else r"\p{Ll}", "u": "A-Z" if ascii_ else r"\p{Lu}"}
    if c in classes:
        return both(classes[c] if inside else f"[{classes[c]}]")
    if c.lower() in classes and c.isupper():
        negated = f"[^\\n{classes[c.lower()]}]"
        return both(negated)
    if c == "N":
        return both(r"[^\n]")
    if c == "R" and not inside:
        r = r"(?:\r\n|[\n\x0B\f\r\x85\u2028\u2029])"
        return both(r)
    if c == "X" and not inside:
        return "[\\s\\S]", "[\\s\\S]", n
    if not inside:
        if c == "<":
            return both(r"\b(?=\w)")
        if c == ">":
            return both(r"\b(?<=\w)")
        if c in "bBAG":
            return "\\" + c, "\\" + c, n
        if c in "zZ":
            return "\\z", "\\Z", n
        if c.isdigit() or c == "k":  # references need the Perl dialect; passed on as they are
            return both("\\" + c)
    if c in "nrtfv":
        return both("\\x0B" if c == "v" else "\\" + c)
    if c == "a":
        return both("\\x07")
    if c == "e":
        return both("\\x1B")
    if c == "b":
        return both("\\x08")
    return both("\\" + c if not c.isalnum() and ord(c) < 128 else re.escape(c) if not c.isalnum() else c)


def _class(p: str, i: int, ascii_: bool, posix_ascii: bool) -> tuple[str, str, int]:
    """(JVM, finder, next index) of the bracket expression at ``i``; subtraction, intersection and union are resolved."""
    end = _class_end(p, i)
    j, negated = i + 1, False
    if p[j] == "^":
        negated, j = True, j + 1
    a: list[str] = []
    b: list[str] = []
    ops: list[tuple[str, str, str]] = []
    first = True
    while j < end - 1:
        c = p[j]
        two = p[j : j + 2]
        if not first and two in ("--", "&&", "||") and j + 2 < end - 1 and p[j + 2] == "[":
            x, y, j = _class(p, j + 2, ascii_, posix_ascii)
            ops.append((two, x, y))
            continue
        first = False
        if p.startswith("[:", j):
            e = p.index(":]", j)
            name = p[j + 2 : e]
            no = name.startswith("^")
            sets = _POSIX_ASCII if posix_ascii else _POSIX
            if name.lstrip("^") not in sets:
                raise PatternError(f"unknown class [:{name}:]")
            body = sets[name.lstrip("^")]
            a.append(f"[^\\n{body}]" if no else body)
            b.append(f"[^\\n{body}]" if no else body)
            j = e + 2
            continue
        if c == "\\":
            x, y, j = _escape(p, j, ascii_, True)
            a.append(x)
            b.append(y)
            continue
        if c == "-" and j + 1 < end - 1 and j > i + 1 and a:
            a.append("-")
            b.append("-")
        else:
            lit = "\\" + c if c in "[]&^-~|\\" or (c in "#" ) else c
            a.append(lit)
            b.append(lit)
        j += 1
    x, y = "".join(a), "".join(b)
    if not ops:
        mark = "^\\n" if negated else ""
        return f"[{mark}{x}]", f"[{mark}{y}]", end
    x, y = f"[{x}]" if x else "", f"[{y}]" if y else ""
    for op, u, v in ops:
        if op == "||":
            x, y = f"[{x}{u}]", f"[{y}{v}]"
        elif op == "&&":
            x, y = f"[{x}&&{u}]", f"[{y}&&{v}]"
        else:
            x, y = f"[{x}&&[^{u}]]", f"[{y}&&[^{v}]]"
    if negated:
        x, y = f"[^\\n{x}]", f"[^\\n{y}]"
    return x, y, end


def translate_ere(p: str, *, ascii_: bool = False) -> Translated:
    """Extended syntax, for both engines."""
    out = _Out(ascii_, False)
    i, depth = 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("\\Q", i):
            e = p.find("\\E", i + 2)
            e = len(p) if e < 0 else e
            out.add(re.escape(p[i + 2 : e]))
            i = e + 2
        elif c == "\\":
            a, b, i = _escape(p, i, ascii_, False)
            out.add(a, b)
        elif c == "[":
            a, b, i = _class(p, i, ascii_, ascii_)
            out.add(a, b)
        elif p.startswith("(?^", i):
            raise PatternError("a negative pattern can only stand as a whole alternative")
        elif p.startswith("(?#", i):
            e = p.find(")", i)
            i = len(p) if e < 0 else e + 1
        elif c == "#":
            out.add("#")
            i += 1
        else:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise PatternError(f"unmatched ) in {p!r}")
            out.add(c)
            i += 1
    if depth:
        raise PatternError(f"missing ) in {p!r}")
    return Translated("".join(out.parts), "".join(out.other))


def split_alternatives(p: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("\\Q", i):
            e = p.find("\\E", i)
            i = len(p) if e < 0 else e + 2
        elif c == "\\":
            i += 2
        elif c == "[":
            i = _class_end(p, i)
        else:
            if c == "|" and depth == 0:
                out.append(p[start:i])
                start = i + 1
            depth += (c == "(") - (c == ")")
            i += 1
    return [*out, p[start:]]


def required_literal(p: str) -> str:
    """The longest literal run that every match of an extended pattern holds, '' if none is sure."""
    if len(split_alternatives(p)) > 1:
        return ""
    best, run, i = "", "", 0
    plain = re.compile(r"[\w ,;:=@!%&\"'<>/~#-]", re.A)
    while i < len(p):
        c = p[i]
        if p.startswith("\\Q", i):
            e = p.find("\\E", i)
            e = len(p) if e < 0 else e
            run += p[i + 2 : e]
            i = e + 2
            nxt = p[i : i + 1]
            if nxt and nxt in "*?{":
                run = run[:-1]
        elif c == "(":  # groups are passed over
            depth, j = 1, i + 1
            while j < len(p) and depth:
                if p[j] == "\\":
                    j += 1
                elif p[j] == "[":
                    j = _class_end(p, j) - 1
                depth += (p[j : j + 1] == "(") - (p[j : j + 1] == ")")
                j += 1
            if p.startswith("(?", i) and not p.startswith("(?:", i):
                return ""  # flags or look-around change what follows
            best, run, i = max(best, run, key=len), "", j
            continue
        elif c == "[":
            best, run, i = max(best, run, key=len), "", _class_end(p, i)
            continue
        elif c == "\\" and i + 1 < len(p) and not p[i + 1].isalnum() and p[i + 1] not in "<>":
            run, i = run + p[i + 1], i + 2
        elif plain.match(c):
            run, i = run + c, i + 1
        else:
            best, run, i = max(best, run, key=len), "", i + (2 if c == "\\" else 1)
            if c == "\\" and p[i - 1 : i] in ("x", "u", "o", "p", "P", "c", "0", "k"):
                return best
            continue
        nxt = p[i : i + 1]
        if nxt and nxt in "*?{":
            best, run = max(best, run[:-1], key=len), ""
            i = p.index("}", i) + 1 if nxt == "{" and "}" in p[i:] else i + 1
        elif nxt == "+":
            best, run, i = max(best, run, key=len), "", i + 1
    return max(best, run, key=len)


def has_upper(p: str) -> bool:
    """Whether a pattern holds a literal ASCII upper-case letter (escapes such as ``\\W`` don't count)."""
    return bool(re.search("[A-Z]", re.sub(r"\\(?:[pP]\{[^}]*\}|[xuo]\{[^}]*\}|.)|\[:\^?\w+:\]", "", p, flags=re.S)))


def _charset(item) -> set[int] | None:
    """Characters below 256 that a one-character item of a parsed pattern matches, None for other items."""
    op, arg = item
    name = str(op)
    if name == "LITERAL":
        return {arg} | {ord(x) for x in chr(arg).swapcase()}
    if name == "ANY":
        return set(range(256)) - {10}
    if name == "NOT_LITERAL":
        return set(range(256)) - {arg}
    if name == "IN":
        found: set[int] = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                found |= _charset((o, a))
            elif str(o) == "RANGE":
                found |= {y for x in range(a[0], min(a[1], 1000) + 1) for y in (x, *(ord(z) for z in chr(x).swapcase()))}
            elif str(o) != "NEGATE":
                return None
        return set(range(1 << 11)) - found if str(arg[0][0]) == "NEGATE" else found
    return None


def _flat(items) -> list | None:
    """A parsed pattern as one sequence of (kind, characters or width): fixed, free (a repeated character) or none; None if unclear."""
    out: list = []
    for op, arg in items:
        name = str(op)
        if name == "SUBPATTERN":
            inner = _flat(arg[-1])
            if inner is None:
                return None
            out += inner
        elif name == "BRANCH":
            ways = [_flat(w) for w in arg[1]]
            if any(w is None or any(k != "fixed" for k, _ in w) for w in ways):
                return None
            widths = {len(w) for w in ways}
            if len(widths) == 1:  # of one width: any characters, for the rules that follow
                out += [("fixed", set(range(1 << 11)))] * widths.pop()
                continue
            literal = [tuple(min(c) for _, c in w) if all(c and len(c) <= 2 for _, c in w) else None for w in ways]
            if None in literal or any(a != b and b[: len(a)] == a for a in literal for b in literal):
                return None  # an alternative may begin another
            out.append(("branch", None))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one = _charset(inner[0]) if len(inner) == 1 else None
            if low == high and name == "MAX_REPEAT" and one is not None:
                out += [("fixed", one)] * low
            elif name == "MAX_REPEAT" and one is not None:
                out.append(("free", one))
            else:
                return None
        elif name == "AT":
            continue
        else:
            one = _charset((op, arg))
            if one is None:
                return None
            out.append(("fixed", one))
    return out


def first_is_longest(alternatives: tuple[str, ...]) -> bool:
    """Whether it is proven that the match an engine takes first is the longest at its place: alternatives are of one width or none
    begins another, and each repeated character but the last is followed by one that it can't match."""
    text = "|".join(f"(?:{a})" for a in alternatives)
    if re.search(r"\[\[|\[:|&&|\|\||~~|--|\\[pPRXhHNKGwWdDsSbBAzZ1-9Qx]|\(\?[^:P<]|\(\?<[=!]", text):
        wrap = re.fullmatch(r"\(\?:\(\?<!\\w\)\(\?:(.*)\)\(\?!\\w\)\)", text)  # whole words of one pattern
        return bool(wrap) and first_is_longest((wrap[1],))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            flat = _flat(_parser.parse(text.replace("(?<", "(?P<")))
    except (re.error, FutureWarning, DeprecationWarning, OverflowError, RecursionError):
        return False
    if flat is None:
        return False
    free = [i for i, (k, _) in enumerate(flat) if k == "free"]
    if free and any(k == "branch" for k, _ in flat[free[0] :]):
        return False  # fewer repeats might allow a longer alternative
    return all(i + 1 < len(flat) and flat[i + 1][0] == "fixed" and not (flat[i][1] & flat[i + 1][1]) for i in free[:-1])


def _width(p: str) -> int | None:
    """Characters of every match of a pattern, None where they may differ or aren't known."""
    if re.search(r"\[\[|\[:|&&|\|\||~~|--|\\[pPRXhHNKGwWdDsSbBAzZ1-9Qx]|\(\?[^:P<]|\(\?<[=!]", p):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            flat = _flat(_parser.parse(p.replace("(?<", "(?P<")))
    except (re.error, FutureWarning, DeprecationWarning, OverflowError, RecursionError):
        return None
    return None if flat is None or any(k != "fixed" for k, _ in flat) else len(flat)


def by_width(made: list[Translated]) -> list[Translated] | None:
    """All alternatives, the widest first, so that the first to match at a place is the longest; None if one has no fixed width."""
    ways: list[tuple[int, Translated]] = []
    for t in made:
        own, other = split_alternatives(t.jvm), split_alternatives(t.finder)
        widths = [_width(x) for x in other]
        if len(own) != len(other) or None in widths:
            return None
        ways += [(n, Translated(a, b)) for n, a, b in zip(widths, own, other)]
    return [t for _, t in sorted(ways, key=lambda w: -w[0])]


@dataclass(frozen=True)
class Compiled:
    """Patterns ready to use: one JVM regex, the finder's alternatives, negatives first, and what holds of all matches."""

    jvm: str
    finder: tuple[str, ...]
    negatives: tuple[str, ...]
    longest: bool
    literal: str
    matches_all: bool
    keeps_empty: bool
    ignore_case: bool
    multiline: bool
    ordered: str = ""  # for the JVM, the widest alternative first; '' where a width isn't fixed

    @property
    def jvm_longest(self) -> str:
        """The JVM regex whose first match is the match to report, '' if that isn't proven of any."""
        return self.jvm if not self.longest or first_is_longest(self.finder) else self.ordered


def compile_patterns(o: SearchOptions) -> Compiled:
    """Translate a search's patterns; alternatives in their order, negatives apart."""
    lines = [x for p in o.patterns for x in p.split("\n")] if o.patterns else []
    positives: list[str] = []
    negatives: list[str] = list(o.negatives)
    for x in lines:
        if o.dialect in ("ere", "bre") and x.startswith("(?^") and x.endswith(")"):
            negatives.append(x[3:-1])
        else:
            positives.append(x)
    matches_all = any(x == "" for x in positives) and not o.whole_line
    fold = o.ignore_case or (o.smart_case and not any(has_upper(x) for x in positives))
    perl = o.dialect == "perl"

    def one(x: str) -> Translated:
        if o.dialect == "fixed":
            return Translated(re.escape(x), re.escape(x))
        if perl:  # the JVM and the finder read Perl syntax; only what differs is changed
            return Translated(re.sub(r"\(\?P<", "(?<", x).replace("\\h", "[ \\t]") if "\\h" in x or "(?P<" in x else x, x)
        return translate_ere(bre_to_ere(x) if o.dialect == "bre" else x, ascii_=o.ascii)

    def wrap(t: Translated) -> Translated:
        if o.free_space:  # a comment at the end must not run into what follows
            t = Translated(t.jvm + "\n", t.finder + "\n")
        if o.whole_line:
            return Translated(f"^(?:{t.jvm})$", f"^(?:{t.finder})$")
        if o.word:
            return Translated(rf"(?<!\w)(?:{t.jvm})(?!\w)", rf"(?<!\w)(?:{t.finder})(?!\w)")
        return t

    plain = [one(x) for x in positives]
    made = [wrap(t) for t in plain]
    # case folding is left out: the engines don't fold alike
    ordered = None if perl or fold or o.free_space else by_width(plain)
    against = [wrap(one(x)) for x in negatives]
    flags = "(?d" + ("i" if fold else "") + ("u" if fold and perl else "") + ("" if o.ascii else "U") + ("s" if o.dot_all else "") + ("x" if o.free_space else "") + "m)"
    multiline = any(re.search(r"\\n|\\R|\n|\\x0A|\(\?s|\[\^?[^\]]*\\n", x) for x in positives) or o.dot_all
    ends = all(x.startswith("^") or x.endswith("$") for x in positives) if positives else False
    sure = [required_literal(bre_to_ere(x) if o.dialect == "bre" else x) if o.dialect in ("ere", "bre") else x if o.dialect == "fixed" else "" for x in positives]
    return Compiled(
        jvm=flags + "|".join(f"(?:{t.jvm})" for t in made) if made else "(?!)",
        finder=tuple(t.finder for t in made), negatives=tuple(t.finder for t in against), longest=not perl, literal=sure[0] if len(sure) == 1 and not fold and not o.free_space else "",
        matches_all=matches_all, keeps_empty=o.empty or ends or matches_all, ignore_case=fold, multiline=multiline,
        ordered=flags + "|".join(f"(?:{wrap(t).jvm})" for t in ordered) if ordered else "")
