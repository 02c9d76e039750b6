"""Tables of lines in texts, read by a table function: rows that wrap over lines, with or without tax rate and unit.

The function takes batches of texts and walks through each one's lines with a small state: before the header, between rows, in a row. A row
begins with a code at the start of a line and goes on, over as many lines as it takes, to the next code behind its numbers or to the totals; what
is neither code nor one of the columns is its name. Which numbers are the columns is told by arithmetic where it can be.

Defined results: null texts and texts without a header have no rows; rows with fewer than three numbers, a name of less than three letters, or
amounts above the limits are none; repeated rows of a text count once; repeated and null doc_ids keep their own rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf

# Words of a table's header and of what ends it, words that are no codes, limits of a row's amounts.
HEADER = ("code", "designation", "désignation")
HEADER_END = ("total", "montant")
STOPS = ("taux", "montant", "droit", "arrete", "arrêté", "arrété", "poste", "coupon", "total", "sous-total", "net")
NO_CODES = set("CODE TOTAL POSTE BASE TVA TAX MONTANT VERSEMENT COUPON BULLETIN REFERENCE RÉFÉRENCE SOUS ADRESSE TELEPHONE TÉLÉPHONE SITE WEB RC".split())
MOST_QUANTITY, MOST_AMOUNT, MOST_RATE = 10_000, 1_000_000, 30

_CODE, _NUMBER, _UNIT = re.compile(r"[A-Z][A-Z0-9.]{1,12}"), re.compile(r"\d+(?:[.,]\d+)*%?"), re.compile(r"[^\W\d]{1,6}\.?")
SCHEMA = "doc_id long, line_no int, code string, designation string, quantity double, unit string, tax_rate double, price double, total double"
_KINDS = pa.schema(
    [("doc_id", pa.int64()), ("line_no", pa.int32()), ("code", pa.string()), ("designation", pa.string()), ("quantity", pa.float64()), ("unit", pa.string()), ("tax_rate", pa.float64()), ("price", pa.float64()), ("total", pa.float64())]
)


def number(token: str) -> float:
    """The last of two kinds of separators is the decimal one; a single one is too."""
    if token.isdecimal():
        return float(token)
    token = token.rstrip("%")
    if "," in token and "." in token:
        token = token.replace("." if token.rindex(",") > token.rindex(".") else ",", "")
    elif token.count(",") + token.count(".") > 1:
        token = re.sub("[.,]", "", token)
    return float(token.replace(",", "."))


def is_number(token: str) -> bool:
    return token.isdecimal() or (token[:1].isdecimal() and _NUMBER.fullmatch(token) is not None)


def columns(tokens: list[str], shown: list[bool]) -> tuple | None:
    """Name, quantity, unit, rate, price and total of a row's tokens behind its code; ``shown`` tells which are numbers. The columns are a run of
    three numbers or more, perhaps with a unit behind the first. Where several can be read, the first wins whose total is quantity times price,
    else the first without a unit."""
    best, lettered, size = None, False, len(tokens)
    # Where the run of numbers that a token stands in ends; the token's own place where it is none.
    ends, end = [0] * (size + 1), size
    for i in range(size - 1, -1, -1):
        if not shown[i]:
            end = i
        ends[i] = end
    ends[size] = size
    for i, token in enumerate(tokens):
        if not shown[i] or not lettered:
            lettered = lettered or token.isalpha() or any(c.isalpha() for c in token)
            continue
        at, unit = i + 1, None
        if at < size and not shown[at] and _UNIT.fullmatch(tokens[at]):
            unit, at = tokens[at], at + 1
        many = 1 + ends[at] - at
        if many < 3:
            continue
        quantity, *numbers = map(number, (token, *tokens[at : at + 3]) if many > 3 else (token, *tokens[at : at + 2]))
        rated = many > 3 and 0 <= numbers[0] <= MOST_RATE
        price, total = numbers[1:3] if rated else numbers[:2]
        right = abs(quantity * price - total) <= 0.01 * max(total, 1)
        key = not right, unit is not None
        if quantity <= MOST_QUANTITY and price <= MOST_AMOUNT and total <= MOST_AMOUNT and (best is None or key < best[0]):
            name = " ".join([*tokens[:i], *tokens[at + (3 if rated else 2) :]]).strip(" :-")
            if len(name) >= 3:
                best = key, (name, quantity, unit, numbers[0] if rated else None, price, total)
                if right and unit is None:
                    break
    return best and best[1]


class Walk:
    """The state of one text's walk: the code and the tokens of the row that is open, and which and how many of them are numbers."""

    def __init__(self):
        self.rows: dict[tuple, None] = {}
        self.code: str | None = None
        self.tokens: list[str] = []
        self.shown: list[bool] = []
        self.numbers = 0

    def close(self) -> None:
        if self.code and self.numbers >= 3 and (row := columns(self.tokens, self.shown)):
            self.rows[self.code, *row] = None
        self.code, self.tokens, self.shown, self.numbers = None, [], [], 0

    def line(self, tokens: list[str]) -> None:
        shown = tokens[0].strip(":-") if tokens else ""
        if shown in NO_CODES:
            self.close()
        elif (self.code is None or self.numbers >= 3) and _CODE.fullmatch(shown):
            self.close()
            self.code, tokens = shown, tokens[1:]
        if self.code:
            for token in tokens:
                if token != "%":
                    known = is_number(token)
                    self.tokens.append(token)
                    self.shown.append(known)
                    self.numbers += known


def items(text: str) -> list[tuple]:
    """code, name, quantity, unit, rate, price and total of each row, in order, repeats once."""
    walk, inside = Walk(), False
    for line in text.splitlines():
        tokens = line.split()
        if not inside:
            low = line.lower()
            if any(w in low for w in HEADER):
                words = [t.strip(":;,.").lower() for t in tokens]
                inside = any(w in HEADER for w in words) and any(w.startswith(HEADER_END) for w in words)
        elif tokens and tokens[0].strip(":;,.").lower() in STOPS:
            break
        else:
            walk.line(tokens)
    walk.close()
    return list(walk.rows)


@arrow_udtf(returnType=SCHEMA)
class TableItems:
    """The rows of the texts of a table argument (doc_id, raw_text)."""

    def eval(self, docs: pa.RecordBatch) -> Iterator[pa.Table]:
        found = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("raw_text").to_pylist(), strict=True):
            found += [(doc_id, k + 1, *row) for k, row in enumerate(items(text or ""))]
        columns = zip(*found, strict=True) if found else [()] * len(_KINDS)
        yield pa.Table.from_arrays(list(map(pa.array, columns, _KINDS.types)), schema=_KINDS)


def table_items(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per line of a document's table; documents stay where they are."""
    return TableItems(doc.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as raw_text").asTable())
