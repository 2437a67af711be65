"""Patterns written for ECMAScript engines, made to mean the same in Java's.

ECMAScript's ``\\s`` holds no-break and other Unicode spaces, its ``\\b`` and
``\\w`` know ASCII only, ``$`` is the very end, and escapes are ``\\uXXXX``.
Java differs in each of these.
"""

from __future__ import annotations

#: What \\s matches in ECMAScript, for use inside a Java class.
SPACES = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACES}]"
WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def js(pattern: str, flags: str = "") -> str:
    """The Java pattern that matches what ``pattern`` matches with ECMAScript flags ``flags``."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            follow = pattern[k + 1]
            if follow == "u":
                out.append(rf"\x{{{pattern[k + 2 : k + 6]}}}")
                k += 6
                continue
            if follow == "s":
                out.append(SPACES if inside else WS)
            elif follow == "S" and not inside:
                out.append(f"[^{SPACES}]")
            elif follow == "b" and not inside:
                out.append(_BOUNDARY)
            else:
                out.append(c + follow)
            k += 2
            continue
        if inside:
            inside = c != "]"
            # Java gives [ and && in a class a meaning of their own
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[k + 1] == "^":
                out.append("^")
                k += 1
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        k += 1
    return ("(?iu)" if "i" in flags else "") + "".join(out)
