"""The reports computed line by line in plain Python, for small ledgers.

Rows come as tuples in schema order. Amounts are Decimals; results are floats.
"""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from finstat.schema import ASSET_SECTIONS, EQUITY_SECTIONS, LIABILITY_SECTIONS


def key(name):
    """What names match and group by."""
    return None if name is None else name.rstrip(" ").upper()


def spelling(sections):
    """The name as the section with the smallest id spells it, of (id, name) pairs."""
    known = [pair for pair in sections if pair[0] is not None]
    return min(known)[1] if known else None


def nonzero(value):
    """SQL ``value != 0`` as a filter sees it."""
    return value is not None and value != 0


class Book:
    def __init__(self, lines, entries, accounts, sections):
        entry_of = {entry[0]: entry for entry in entries}
        account_of = {account[0]: account for account in accounts}
        section_of = {section[0]: section for section in sections}
        nothing = (None,) * 8
        self.lines = []
        for entry_id, account_id, item, _, debit, credit in lines:
            entry = entry_of.get(entry_id, nothing)
            account = account_of.get(account_id, nothing)
            pl = section_of.get(account[4], nothing)
            bs = section_of.get(account[5], nothing)
            line = {
                "item": item, "debit": debit, "credit": credit,
                "account": account, "entry": entry, "pl": pl, "bs": bs,
                "name": pl[1] if key(pl[1]) not in (None, "") else bs[1],
                "year": entry[3].year if entry[3] else None,
            }
            line["kept"] = entry[4] == 1 and nonzero(entry[5]) and entry[7] == 0
            line["posted"] = line["kept"] and entry[6] == 0
            self.lines.append(line)

    def posted(self, fy=None):
        return [line for line in self.lines if line["posted"] and (fy is None or line["year"] == fy)]


def pl_amount(line):
    debit, credit = line["debit"] or Decimal(0), line["credit"] or Decimal(0)
    return {1: credit + debit, 0: credit - debit}.get(line["pl"][2])


def sides(line):
    """(assets, liabilities, equity) of one line."""
    debit, credit, name = line["debit"], line["credit"], key(line["name"])
    if credit is None:
        up = debit or Decimal(0)
    elif debit is None:
        up = -credit
    else:
        up = Decimal(0)
    zero = Decimal(0)
    return (
        up if name in ASSET_SECTIONS else zero,
        -up if name in LIABILITY_SECTIONS else zero,
        -up if name in EQUITY_SECTIONS else zero,
    )


def sheet_amount(line):
    """One amount per line; a credit on an asset counts nothing."""
    assets, liabilities, equity = sides(line)
    return (assets if line["credit"] is None else Decimal(0)) + liabilities + equity


def total(values):
    known = [value for value in values if value is not None]
    return float(sum(known).quantize(Decimal("0.01"), ROUND_HALF_UP)) if known else None


def as_float(value):
    return None if value is None else float(value)


def growth(current, previous):
    if current is None or previous is None or current == 0:
        return None
    exact = (Decimal(str(current)) - Decimal(str(previous))) / Decimal(str(current)) * 100
    return float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))


def grouped(lines, key):
    groups = defaultdict(list)
    for line in lines:
        groups[key(line)].append(line)
    return groups


def named(line):
    """The section that gives a line its aligned name."""
    return line["pl"][:2] if key(line["pl"][1]) not in (None, "") else line["bs"][:2]


def either(line):
    return nonzero(line["pl"][0]) or nonzero(line["bs"][0])


def line_count(book, fy):
    return [(sum(line["year"] == fy for line in book.lines),)]


def section_totals(book, fy):
    lines = [x for x in book.lines if x["kept"] and x["year"] == fy and nonzero(x["pl"][0])]
    return [
        (spelling(x["pl"][:2] for x in group), flag, len(group), total(x["debit"] for x in group), total(x["credit"] for x in group))
        for (_, flag), group in grouped(lines, lambda x: (key(x["pl"][1]), x["pl"][2])).items()
    ]


def pl_by_year(book):
    lines = [x for x in book.posted() if key(x["pl"][1]) not in (None, "")]
    return [
        (spelling(x["pl"][:2] for x in group), year, total(pl_amount(x) for x in group))
        for (_, year), group in grouped(lines, lambda x: (key(x["pl"][1]), x["year"])).items()
    ]


def by_section(lines):
    groups = grouped([x for x in lines if nonzero(x["pl"][0])], lambda x: (x["pl"][0], key(x["pl"][1])))
    return [(spelling(x["pl"][:2] for x in groups[k]), groups[k]) for k in sorted(groups)]


def pl_one_year(book, fy):
    return [(name, total(pl_amount(x) for x in group)) for name, group in by_section(book.posted(fy))]


def pl_yoy(book, fy):
    result = []
    for name, group in by_section(book.posted()):
        current, previous = (total(pl_amount(x) for x in group if x["year"] == y) for y in (fy, fy - 1))
        result.append((name, current, previous, growth(current, previous)))
    return result


def section_crosstab(book, fy):
    groups = grouped(filter(either, book.posted(fy)), lambda x: (key(x["pl"][1]), key(x["bs"][1])))
    return [(spelling(x["pl"][:2] for x in g), spelling(x["bs"][:2] for x in g), len(g)) for g in groups.values()]


def master_lines(book, fy):
    return [
        (
            x["name"], x["account"][1], x["account"][0], x["account"][2], x["item"], x["account"][3],
            x["entry"][1], x["entry"][2], x["bs"][0], x["bs"][3], as_float(x["debit"]), as_float(x["credit"]),
        )
        for x in book.posted(fy) if either(x)
    ]


def master_classified(book, fy):
    return [
        (x["account"][3], x["name"], x["account"][1], x["entry"][2], x["entry"][1], x["item"], *(total([side]) for side in sides(x)))
        for x in book.posted(fy) if either(x)
    ]


def bs_by_account(book, fy):
    lines = [x for x in book.posted(fy) if x["bs"][3] == 1]
    return [
        (code, spelling(named(x) for x in group), *(total(column) for column in zip(*map(sides, group))))
        for (code, _), group in grouped(lines, lambda x: (x["account"][2], key(x["name"]))).items()
    ]


def accounting_equation(book, fy):
    lines = book.posted(fy)
    assets, liabilities, equity = (total(c) for c in zip(*map(sides, lines))) if lines else (None, None, None)
    return [(assets, "=", liabilities, "+", equity)]


def bs_yoy(book, fy):
    groups = grouped([x for x in book.posted() if x["bs"][3] == 1], lambda x: key(x["name"]))
    result = []
    for name in sorted(groups, key=lambda name: (name is not None, name or "")):
        current, previous = (
            total(sheet_amount(x) if x["year"] == y else Decimal(0) for x in groups[name]) for y in (fy, fy - 1)
        )
        result.append((spelling(named(x) for x in groups[name]), current, previous, growth(current, previous)))
    return result
