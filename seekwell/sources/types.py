"""File types: names with the extensions, base names and (for capital names) first bytes that make them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.globs import magic_condition

_X = {
    "actionscript": "as mxml", "ada": "ada adb ads", "asm": "asm s S", "asp": "asp", "aspx": "master ascx asmx aspx svc", "autoconf": "ac in", "automake": "am in", "awk": "awk", "basic": "bas BAS cls frm ctl vb", "batch": "bat BAT cmd CMD",
    "bison": "y yy yxx", "c": "c h H hdl xs", "c++": "cpp CPP cc cxx CXX h hh H hpp hxx Hxx HXX", "clojure": "clj", "csharp": "cs", "css": "css", "csv": "csv", "dart": "dart", "delphi": "pas int dfm nfm dof dpk dproj groupproj bdsgroup bdsproj",
    "elisp": "el", "elixir": "ex exs", "erlang": "erl hrl", "fortran": "for ftn fpp f F f77 F77 f90 F90 f95 F95 f03 F03", "gif": "gif", "go": "go", "groovy": "groovy gtmpl gpp grunit gradle", "gsp": "gsp", "haskell": "hs lhs", "html": "htm html xhtml",
    "jade": "jade", "java": "java properties", "jpeg": "jpg jpeg", "js": "js", "json": "json", "jsp": "jsp jspx jhtm jhtml", "julia": "jl", "kotlin": "kt kts", "less": "less", "lex": "l ll lxx", "lisp": "lisp lsp", "lua": "lua", "m4": "m4", "make": "mk mak",
    "markdown": "md", "matlab": "m", "node": "js", "objc": "m h", "objc++": "mm h", "ocaml": "ml mli mll mly", "parrot": "pir pasm pmc ops pod pg tg", "pascal": "pas pp", "pdf": "pdf", "perl": "pl PL pm pod t psgi", "php": "php php3 php4 phtml", "png": "png",
    "prolog": "pl pro", "python": "py", "r": "R", "rpm": "rpm", "rst": "rst", "rtf": "rtf", "ruby": "rb rhtml rjs rxml erb rake spec", "rust": "rs", "scala": "scala", "scheme": "scm ss", "shell": "sh bash dash csh tcsh ksh zsh fish", "smalltalk": "st",
    "sql": "sql ctl", "svg": "svg", "swift": "swift", "tcl": "tcl itcl itk", "tex": "tex cls sty bib", "text": "text txt TXT md rst", "tiff": "tif tiff", "tt": "tt tt2 ttml", "typescript": "ts tsx", "verilog": "v vh sv", "vhdl": "vhd vhdl", "vim": "vim",
    "xml": "xml xsd xsl xslt wsdl rss svg ent plist", "yacc": "y", "yaml": "yaml yml", "zig": "zig", "toml": "toml", "cmake": "cmake",
}
_NAMES = {"make": ["Makefile", "makefile", "GNUmakefile", "Makefile.Debug", "Makefile.Release"], "ruby": ["Rakefile", "Gemfile"], "autoconf": ["configure.ac"], "cmake": ["CMakeLists.txt"], "rust": ["Cargo.toml"]}
_MAGIC = {
    "shell": r"#!\s*/[^\n]*(?:ba|da|t?c|k|z|fi)?sh\b", "perl": r"#!\s*/[^\n]*perl", "python": r"#!\s*/[^\n]*python[23]?", "ruby": r"#!\s*/[^\n]*ruby", "php": r"#!\s*/[^\n]*php|<\?php", "tcl": r"#!\s*/[^\n]*(?:tclsh|wish)", "node": r"#!\s*/[^\n]*node",
    "lua": r"#!\s*/[^\n]*lua", "xml": r"<\?xml", "html": r"(?i)\s*<(?:!doctype html|html)", "pdf": r"%PDF-", "png": r"\x89PNG\r\n\x1A\n", "gif": r"GIF8[79]a", "jpeg": r"\xFF\xD8\xFF", "rtf": r"\{\\rtf", "svg": r"(?:<\?xml[^>]*>\s*)?<svg", "tiff": r"II\x2A\x00|MM\x00\x2A",
}


def type_names() -> list[str]:
    return sorted(_X)


def resolve(name: str) -> str:
    """A full type name from a unique prefix."""
    found = [t for t in _X if t == name.lower()] or [t for t in _X if t.startswith(name.lower())]
    if len(found) != 1:
        raise ValueError(f"unknown or ambiguous type {name!r}: {', '.join(found)}")
    return found[0]


def type_condition(path, types: str, content: str | None = None) -> Column:
    """A comma list of types; a capital first letter also looks at the first bytes, ``!`` or ``^`` negates one."""
    path = F.col(path) if isinstance(path, str) else path
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    yes, no = [], []
    for item in filter(None, types.split(",")):
        negate, name = item[0] in "!^", item.lstrip("!^")
        t = resolve(name)
        c = ext.isin(_X[t].split()) & F.contains(base, F.lit("."))
        if t in _NAMES:
            c = c | base.isin(_NAMES[t])
        if name[0].isupper() and content and t in _MAGIC:
            c = c | magic_condition(content, _MAGIC[t])
        (no if negate else yes).append(c)
    out = F.lit(True)
    if yes:
        out = yes[0]
        for c in yes[1:]:
            out = out | c
    for c in no:
        out = out & ~c
    return out
