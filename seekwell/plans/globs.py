"""Path selection: globs as regexes, include and exclude rules, ignore files, types, sizes, depth.

All rules become conditions on path columns, so they prune before any content is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored JVM regex: ``*`` and ``?`` and classes stay within a path segment, ``**/`` is any directories, a last
    ``/**`` anything below; any other ``**`` matches nothing."""
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            if glob.startswith("**", i):
                if glob.startswith("**/", i):
                    out.append("(?:[^/]*/)*" if i == 0 or glob[i - 1] == "/" else ".*/")
                    i += 3
                    continue
                if i + 2 == n:
                    out.append(".*")
                    i += 2
                    continue
                return "(?!)"
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = i + 1
            negated = j < n and glob[j] in "!^"
            j += negated
            k = glob.find("]", j + 1)
            if k < 0:
                out.append("\\[")
            else:
                body = "".join("\\" + x if x in "[]&^\\" else x for x in glob[j:k].replace("\\", ""))
                out.append(f"(?!/)[{'^' if negated else ''}{body}]")
                i = k
        elif c == "\\" and i + 1 < n:
            out.append(re.escape(glob[i + 1]))
            i += 1
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def normal_path(path) -> Column:
    """Leading ``./`` and ``/`` don't count."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"^(?:\./|/)+", "")


def glob_condition(path, glob: str, *, ignore_case: bool = False) -> Column:
    """Whether a path matches: a glob with a slash is for the whole path, another for the base name (or, ending in a slash, a directory)."""
    path = F.col(path) if isinstance(path, str) else path
    flag = "(?si)" if ignore_case else "(?s)"
    if glob.endswith("/") and len(glob) > 1:
        return in_directory(path, glob[:-1], ignore_case=ignore_case)
    if "/" in glob:
        return normal_path(path).rlike(f"{flag}\\A{glob_regex(glob.removeprefix('/').removeprefix('./'))}\\z")
    return F.element_at(F.split(path, "/"), -1).rlike(f"{flag}\\A{glob_regex(glob)}\\z")


def in_directory(path, glob: str, *, ignore_case: bool = False) -> Column:
    """Whether some directory above the path matches."""
    path = normal_path(path)
    flag = "(?si)" if ignore_case else "(?s)"
    if "/" in glob:
        return path.rlike(f"{flag}\\A{glob_regex(glob.strip('/'))}/")
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d.rlike(f"{flag}\\A{glob_regex(glob)}\\z"))


def globs_condition(path, globs: str | list[str], *, ignore_case: bool = False, exclude: list[str] = ()) -> Column:
    """A comma list of globs; ``!`` or ``^`` negates one. What is excluded wins over what is included."""
    items = [g for part in ([globs] if isinstance(globs, str) else globs) for g in part.split(",") if g]
    yes = [g for g in items if g[0] not in "!^"]
    no = [g[1:] for g in items if g[0] in "!^"] + list(exclude)
    any_of = lambda gs: _any([glob_condition(path, g, ignore_case=ignore_case) for g in gs])
    out = any_of(yes) if yes else F.lit(True)
    return out & ~any_of(no) if no else out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rules_of(text: str) -> list[tuple[str, bool]]:
    """Globs of a rule file with whether each is an override (``!``); comments and blank lines dropped."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if line and not line.startswith("#"):
            out.append((line[1:], True) if line.startswith("!") else (line.removeprefix("\\"), False))
    return out


def last_rule(path, rules: list[tuple[str, bool]], *, default: bool = False, ignore_case: bool = False) -> Column:
    """Whether rules select a path: of the rules that match, the last decides."""
    out = F.lit(default)
    for glob, override in rules:
        out = F.when(glob_condition(path, glob, ignore_case=ignore_case), F.lit(not override)).otherwise(out)
    return out


def ignored(files: DataFrame, ignore_files: dict[str, str], *, path: str = "path", ignore_case: bool = False) -> Column:
    """Whether a file is ignored: ``ignore_files`` maps a directory to the text of its ignore file, which holds below it.

    A rule is for entries themselves, files and (alone, if it ends in a slash) directories, and the last that matches an entry decides
    for it; a directory that is ignored takes what is below along, but for files that a later override names. Deeper files
    decide after the ones above them; ignore files are few and read on the driver. Null for a path that is null."""
    rules = []
    for scope in sorted(ignore_files, key=lambda d: (d.count("/") if d not in ("", ".") else -1, d)):
        prefix = "" if scope in ("", ".") else scope.strip("/") + "/"
        rules += [(prefix, glob, override) for glob, override in rules_of(ignore_files[scope]) if glob.strip("/")]

    def last(entry: Column, name: Column, directory: bool) -> Column:
        """Number of the last rule that matches, below 0 for an override; 0 for none."""
        out = F.lit(0)
        for n, (prefix, glob, override) in enumerate(rules, 1):
            if directory or not glob.endswith("/"):
                out = F.when(_ignore_rule(entry, name, prefix, glob, ignore_case), F.lit(-n if override else n)).otherwise(out)
        return out

    full = normal_path(path)
    parts = F.split(full, "/")
    own = last(full, F.element_at(parts, -1), False)
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d, i: last(F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), d, True))
    return F.when(full.isNotNull(), F.greatest(own, F.array_max(above)) > F.greatest(-own, F.lit(0)))


def _ignore_rule(entry: Column, name: Column, prefix: str, glob: str, ignore_case: bool) -> Column:
    g = glob.rstrip("/")
    flag = "(?si)" if ignore_case else "(?s)"
    if "/" in g:
        return entry.rlike(f"(?s)\\A{re.escape(prefix)}{flag}{glob_regex(g.removeprefix('./').removeprefix('/'))}\\z")
    hit = name.rlike(f"{flag}\\A{glob_regex(g)}\\z")
    return F.startswith(entry, F.lit(prefix)) & hit if prefix else hit


def size_bytes(text: str) -> int:
    """``10``, ``4k``, ``2MB``..."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)(i?b)?", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def size_condition(column="length", least: str | None = None, most: str | None = None) -> Column:
    """A range of sizes, in a form that is pushed into the file source."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(True)
    if least is not None:
        out = out & (c >= size_bytes(least))
    return out & (c <= size_bytes(most)) if most is not None else out


def depth_condition(path, least: int = 1, most: int | None = None) -> Column:
    depth = F.size(F.split(normal_path(path), "/"))
    out = depth >= least
    return out & (depth <= most) if most is not None else out


def hidden(path) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(r"(?:^|/)\.[^./]|(?:^|/)\.\.[^/]")


def extension_condition(path, extensions: str) -> Column:
    """A comma list of extensions; ``!`` or ``^`` negates one."""
    items = [e for e in extensions.split(",") if e]
    ext = F.regexp_extract(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1), r"\.([^.]*)$", 1)
    yes, no = [e for e in items if e[0] not in "!^"], [e[1:] for e in items if e[0] in "!^"]
    out = ext.isin(yes) if yes else F.lit(True)
    return out & ~ext.isin(no) if no else out


def magic_condition(content, pattern: str, *, most: int = 512) -> Column:
    """A regex at the very start of the bytes; a leading ``!`` or ``^!`` negates it."""
    negate = pattern.startswith("!")
    head = F.decode(F.substring(F.col(content) if isinstance(content, str) else content, F.lit(1), F.lit(most)), "ISO-8859-1")
    found = head.rlike(f"(?s)\\A(?:{pattern.removeprefix('!')})")
    return ~found if negate else found
