"""Ready-made patterns by language and name, for ``SearchOptions(patterns=...)``.

``zap_`` entries are negative patterns: given with others, they discard what those would find inside comments,
strings or directives.  ``data`` holds patterns for records: addresses, links, keys.
"""

from __future__ import annotations

_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\n|\*+(?:[^*/]|\n))*\*+/"
_HASH = r"#[^\n]*"
_NAME = r"\b[A-Za-z_]\w*\b"
_C_STRINGS = _DQ + "|" + _SQ
_C_FUNCTION = r"^[ \t]*(?:[A-Za-z_][\w:<>,*&~ \t]*[ \t*&])?[A-Za-z_]\w*[ \t]*\([^;{}()\n]*\)[ \t\n]*(?:const[ \t\n]*)?\{"


def _zap(patterns: dict[str, str], *names: str) -> dict[str, str]:
    return patterns | {f"zap_{n}": "\n".join(f"(?^{p})" for p in [patterns[n]]) for n in names if n in patterns}


def _c(**more: str) -> dict[str, str]:
    base = {
        "comments": _C_COMMENT, "doc_comments": r"///[^\n]*|//![^\n]*|/\*\*(?:[^*]|\n|\*+(?:[^*/]|\n))*\*+/", "strings": _C_STRINGS, "names": _NAME, "functions": _C_FUNCTION,
        "enums": r"\benum\b[^;{}\n]*\{", "structs": r"\bstruct\b[^;{}()\n]*\{", "typedefs": r"\btypedef\b[^;]*;", "defines": r"^[ \t]*#[ \t]*define\b[^\n]*", "directives": r"^[ \t]*#[ \t]*[a-z]+[^\n]*", "includes": r"^[ \t]*#[ \t]*include\b[^\n]*",
        "commands": r"^[ \t]*#[ \t]*[a-z]+[^\n]*",
    }
    out = _zap(base | more, "comments", "strings", "directives", "commands")
    del out["commands"]
    return out


_CPP = _c(classes=r"\b(?:class|struct)[ \t\n]+[A-Za-z_]\w*[^;{}()]*\{", namespaces=r"\bnamespace\b[^;{}()\n]*\{")


def _braces(keep: str, **more: str) -> dict[str, str]:
    base = {"comments": _C_COMMENT, "strings": _C_STRINGS, "names": _NAME}
    return _zap({k: v for k, v in (base | more).items() if k in keep.split() or k in more}, "comments", "strings")


CATALOG: dict[str, dict[str, str]] = {
    "c": _c(), "c++": _CPP, "cpp": _CPP,
    "cs": _braces("comments strings names", classes=r"\b(?:class|interface|struct|record)[ \t\n]+[A-Za-z_]\w*[^;{}()]*\{", doc_comments=r"///[^\n]*", enums=r"\benum\b[^;{}\n]*\{", functions=_C_FUNCTION),
    "html": {
        "comments": r"<!--(?:[^-]|\n|-[^-]|--[^>])*-->", "href": r"\bhref[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*')", "img": r"<img\b[^>]*>", "link": r"<link\b[^>]*>", "meta": r"<meta\b[^>]*>", "pre": r"<pre\b[^>]*>(?:[^<]|\n|<[^/])*</pre>",
        "script": r"<script\b[^>]*>(?:[^<]|\n|<[^/]|</[^s])*</script>", "src": r"\bsrc[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*')", "style": r"<style\b[^>]*>(?:[^<]|\n|<[^/])*</style>", "zap_comments": r"(?^<!--(?:[^-]|\n|-[^-]|--[^>])*-->)",
    },
    "java": _braces("comments strings names", classes=r"\b(?:class|interface|record)[ \t\n]+[A-Za-z_]\w*[^;{}()]*\{", doc_comments=r"/\*\*(?:[^*]|\n|\*+(?:[^*/]|\n))*\*+/", enums=r"\benum\b[^;{}\n]*\{", imports=r"^[ \t]*import\b[^;\n]*;", methods=_C_FUNCTION),
    "js": _braces("comments names", strings=_C_STRINGS + r"|`(?:[^`\\]|\n|\\.)*`", classes=r"\bclass\b[^;{}()\n]*\{", dom=r"\b(?:document|window)\.[A-Za-z_.]+", functions=r"\bfunction\b[ \t*]*[A-Za-z_$]*[ \t]*\([^()\n]*\)|\([^()\n]*\)[ \t]*=>"),
    "json": {"keys": r'"(?:[^"\\\n]|\\.)*"(?=[ \t]*:)', "values": r'(?<=:)[ \t]*(?:"(?:[^"\\\n]|\\.)*"|-?\d[\d.eE+-]*|true|false|null)', "keys_and_values": r'"(?:[^"\\\n]|\\.)*"[ \t]*:[ \t]*(?:"(?:[^"\\\n]|\\.)*"|-?\d[\d.eE+-]*|true|false|null)'},
    "markdown": {"code": r"`[^`\n]+`", "codeblocks": r"^```[^\n]*\n(?:[^`]|\n|`[^`])*```", "images": r"!\[[^\]\n]*\]\([^)\n]*\)", "links": r"\[[^\]\n]*\]\([^)\n]*\)", "sections": r"^#+[ \t][^\n]*"},
    "perl": _zap({"comments": _HASH, "formats": r"^format\b[^\n]*=", "names": r"[$@%&]?[A-Za-z_]\w*", "strings": _C_STRINGS, "subs": r"\bsub[ \t]+[A-Za-z_]\w*"}, "comments", "formats", "strings"),
    "php": _zap({"comments": _C_COMMENT + "|" + _HASH, "functions": r"\bfunction[ \t]+&?[A-Za-z_]\w*[ \t]*\([^()\n]*\)", "names": r"\$?[A-Za-z_]\w*", "strings": _C_STRINGS, "html": r"\?>(?:[^<]|\n|<[^?])*(?:<\?php)?"}, "comments", "html", "strings"),
    "python": _zap({"comments": _HASH, "defs": r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+[A-Za-z_]\w*", "doc_strings": r'"""(?:[^"\\]|\n|\\.|"[^"]|""[^"])*"""', "imports": r"^[ \t]*(?:import|from)\b[^\n]*", "names": _NAME, "strings": _C_STRINGS}, "comments", "strings"),
    "ruby": _zap({"classes": r"^[ \t]*class[ \t]+[A-Z]\w*", "comments": _HASH, "defs": r"^[ \t]*def[ \t]+[\w.]+[?!]?", "modules": r"^[ \t]*module[ \t]+[A-Z]\w*", "names": r"[@$]*[A-Za-z_]\w*[?!]?", "strings": _C_STRINGS}, "comments", "strings"),
    "rust": _braces("comments strings names", crates=r"\bextern[ \t]+crate\b[^;\n]*;", enums=r"\benum[ \t]+\w+[^;{}\n]*\{", fns=r"\bfn[ \t]+[A-Za-z_]\w*", impls=r"\bimpl\b[^;{}\n]*\{", macros=r"\bmacro_rules![ \t]*\w+", mods=r"\bmod[ \t]+\w+", structs=r"\bstruct[ \t]+\w+", traits=r"\btrait[ \t]+\w+", unions=r"\bunion[ \t]+\w+", uses=r"^[ \t]*(?:pub[ \t]+)?use\b[^;]*;"),
    "scala": _braces("comments strings names", classes=r"\b(?:class|trait)[ \t]+\w+", defs=r"\bdef[ \t]+\w+", imports=r"^[ \t]*import\b[^\n]*", objects=r"\bobject[ \t]+\w+", packages=r"^[ \t]*package\b[^\n]*"),
    "swift": _braces("comments strings names", classes=r"\bclass[ \t]+\w+", enums=r"\benum[ \t]+\w+", funcs=r"\bfunc[ \t]+\w+", imports=r"^[ \t]*import\b[^\n]*", structs=r"\bstruct[ \t]+\w+"),
    "xml": _zap({"attributes": r"[\w:.-]+[ \t]*=(?=[ \t]*[\"'])", "attributes_and_values": r"[\w:.-]+[ \t]*=[ \t]*(?:\"[^\"]*\"|'[^']*')", "comments": r"<!--(?:[^-]|\n|-[^-]|--[^>])*-->", "elements": r"<[\w:.-]+(?:[^<>]|\n)*>[^<]*</[\w:.-]+>", "pis": r"<\?[^?]*\?>", "tags": r"</?[\w:.-]+(?:[^<>]|\n)*>", "strings": r"\"[^\"]*\"|'[^']*'"}, "comments", "pis", "strings"),
    "data": {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://[^ \t\n\"'<>]+", "html_link": r'href="[^"\n]*"', "json_key": r'"[A-Za-z_]\w*"(?=:)', "card": r"\b\d{13,16}\b", "date": r"\b\d{4}-\d{2}-\d{2}\b", "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b"},
}


def pattern(name: str) -> tuple[str, ...]:
    """Patterns of ``language/name``; several names joined by commas are united."""
    out: list[str] = []
    for part in name.split(","):
        language, _, what = part.partition("/")
        try:
            out += CATALOG[language][what].split("\n")
        except KeyError:
            raise KeyError(f"no pattern {part!r}") from None
    return tuple(out)
