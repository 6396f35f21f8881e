"""The same name and numeral rules as SQL text, for temporary functions."""

from __future__ import annotations

from keidai.functions.text import CHARACTERS, DIGITS, HONORIFICS, LIGATURES, SPELLINGS, UNITS, WHITE


def _quote(s: str) -> str:
    return "r'" + s + "'"


def _map(values: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _trim(s: str) -> str:
    return f"regexp_replace({s}, {_quote(f'^[{WHITE}]+|[{WHITE}]+$')}, '')"


def _kansuji() -> str:
    s = _trim("s")
    look = {n: f"try_element_at({_map(v)}, c)" for n, v in (("d", DIGITS), ("u", UNITS), ("l", LIGATURES))}
    step = (
        f"named_struct('section', acc.section + coalesce({look['l']}, coalesce(acc.digit, 1) * {look['u']}, 0), 'digit', {look['d']}, "
        f"'bad', acc.bad OR coalesce({look['d']}, {look['u']}, {look['l']}) IS NULL)"
    )
    fold = (
        f"aggregate(filter(split({s}, ''), x -> x <> ''), named_struct('section', 0, 'digit', CAST(NULL AS INT), 'bad', false), (acc, c) -> {step}, "
        "acc -> CASE WHEN NOT acc.bad THEN acc.section + coalesce(acc.digit, 0) END)"
    )
    return f"CASE WHEN {s} = '' OR {s} RLIKE '[〓■□▲]' THEN NULL WHEN {s} RLIKE '^[0-9]+$' THEN try_cast({s} AS INT) ELSE {fold} END"


def _deity_key() -> str:
    s = _trim("s")
    for pattern, to in (("[（(][^）)]*[）)]", ""), (f"[{WHITE}・･、,。．.]", ""), ("^(主祭神|祭神|本尊|御祭神)[:：]?", ""), *SPELLINGS):
        s = f"regexp_replace({s}, {_quote(pattern)}, '{to}')"
    s = f"translate({s}, '{''.join(CHARACTERS)}', '{''.join(CHARACTERS.values())}')"
    return f"regexp_replace({s}, {_quote('^(.+?)(?:' + '|'.join(HONORIFICS) + ')+$')}, '$1')"


KANSUJI_SQL = _kansuji()
DEITY_KEY_SQL = _deity_key()
