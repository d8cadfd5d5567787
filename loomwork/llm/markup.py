"""Patterns of HTML markup that read a text once, whatever it holds.

Every alternative of ``TOKEN`` takes all it looks at, to the end of the text
where its own end is missing, and gives nothing back (possessive quantifiers):
time is linear in the text, also for runs of unclosed tags, comments or quotes.
"""

from __future__ import annotations

S = r"[ \t\n\f\r]"
#: The rest of a tag: names, white space, and values, of which quoted ones may hold ``>``.
REST = rf"""(?:[^ \t\n\f\r/>=]++|[ \t\n\f\r/]++|={S}*+(?:"[^"]*+"?+|'[^']*+'?+|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?+)*+"""
#: One attribute of a tag, with its value if it has one.
ATTRIBUTE = rf"""[^ \t\n\f\r/>=]++(?:{S}*+={S}*+(?:"[^"]*+"?+|'[^']*+'?+|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?+)?+"""
COMMENT = r"<!--(?:-?+>|(?s:.*?)(?:-->|--!>|\z))"
BOGUS = r"<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\z)"


def letters(name: str) -> str:
    """A pattern of ``name`` in any case of ASCII."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def raw(name: str) -> str:
    """An element whose content is no markup, with its content."""
    return rf"<{letters(name)}(?:[ \t\n\f\r/]{REST})?+(?:>(?s:.*?)(?:</{letters(name)}[ \t\n\f\r/>]|\z)|\z)"


RAW = "|".join(raw(name) for name in ("script", "style", "title", "textarea"))
OTHER = rf"</?+[a-zA-Z]{REST}(?:>|\z)"
#: Group 1 holds link and meta tags; all other markup has it empty.
TOKEN = rf"{COMMENT}|{RAW}|(<(?:{letters('link')}|{letters('meta')})[ \t\n\f\r/]{REST}(?:>|\z))|{OTHER}|{BOGUS}"
#: What stands between two pieces of visible text: tags, comments, scripts and styles; titles and text areas are text.
HIDDEN = rf"{COMMENT}|{raw('script')}|{raw('style')}|{OTHER}|{BOGUS}"
