"""A ledger over order-processing tables (rules: FIXTURES.md section 2).

``lineitem`` becomes the lines, ``orders`` the entries, ``part`` the chart of
accounts. Every rule is a column expression, so scans stay prunable and filters
on the derived columns still reach the files where Catalyst can rewrite them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstat.schema import FLOAT_MONEY, MONEY
from finstat.sources.ledger import Ledger

# Id, name, debit_is_positive, is_balance_sheet_section.
SECTION_ROWS = (
    (0, "", 0, 0),
    (1, "CURRENT ASSETS", 1, 1),
    (2, "FIXED ASSETS", 1, 1),
    (3, "CURRENT LIABILITIES", 0, 1),
    (4, "EQUITY", 0, 1),
    (5, "LONG TERM LIABILITIES", 0, 1),
    (6, "REVENUE", 0, 0),
    (7, "OTHER INCOME", 0, 0),
    (8, "COST OF GOODS AND SERVICES", 1, 0),
    (9, "OTHER EXPENSES", 1, 0),
    (10, "SELLING EXPENSES", 1, 0),
    (11, "INCOME TAX", 1, 0),
    (12, "UNCLASSIFIED RESULT", None, 0),
)


# How the adapter spells some of the names, to tell whether names match and group by one rule:
# other cases, trailing blanks, a blank name, and two spellings of one name (ids 3 and 5).
SPELLINGS = {1: "Current Assets", 5: "current liabilities ", 9: "other expenses", 12: "  "}

# One line in so many points to an entry or to an account that is not there.
NO_ENTRY, NO_ACCOUNT = 97, 89


def section_values() -> str:
    """The section rows as the body of a SQL ``VALUES`` list."""
    return ", ".join(
        f"({number}, '{SPELLINGS.get(number, name)}', {'NULL' if flag is None else flag}, {sheet})"
        for number, name, flag, sheet in SECTION_ROWS
    )


def sections(part: DataFrame) -> DataFrame:
    """The section rows whose numbers are slots of some part, found by reading all parts."""
    rows = part.sparkSession.sql(
        "SELECT CAST(id AS INT) AS statement_section_id, name AS statement_section, "
        "CAST(flag AS INT) AS debit_is_positive, CAST(sheet AS INT) AS is_balance_sheet_section "
        f"FROM VALUES {section_values()} AS s(id, name, flag, sheet)"
    )
    slots = part.select((F.col("p_partkey") % 16).cast("int").alias("statement_section_id")).distinct()
    return slots.join(rows, "statement_section_id").select(*rows.columns)


def accounts(part: DataFrame) -> DataFrame:
    slot = F.col("p_partkey") % 16
    profit_loss = F.when(slot.between(6, 12), slot).when(slot == 14, 6).when(slot != 15, 0)
    balance_sheet = (
        F.when(slot.between(1, 5), slot).when(slot == 13, 2).when(slot == 14, 4).when(slot == 15, 99).otherwise(0)
    )
    return part.select(
        F.col("p_partkey").alias("account_id"),
        F.col("p_name").alias("account"),
        F.col("p_brand").alias("account_code"),
        (F.col("p_size") % 2).cast("int").alias("postable"),
        profit_loss.cast("int").alias("profit_loss_section_id"),
        balance_sheet.cast("int").alias("balance_sheet_section_id"),
    )


def entries(orders: DataFrame) -> DataFrame:
    key, user = F.col("o_orderkey"), F.col("o_custkey") % 50
    date = F.col("o_orderdate").cast("date")
    closing = (F.month(date) == 12) & (F.col("o_orderpriority") == "5-LOW")
    return orders.select(
        key.alias("journal_entry_id"),
        F.col("o_orderpriority").alias("journal_entry"),
        F.concat(F.lit("JE-"), F.lpad(key.cast("string"), 9, "0")).alias("journal_entry_code"),
        date.alias("entry_date"),
        F.when(key % 20 == 0, 0).otherwise(1).alias("debit_credit_balanced"),
        F.when(user != 1, user).alias("user_id"),
        F.when(key % 25 == 7, 1).when(key % 25 != 8, 0).alias("cancelled"),
        F.when(closing, 1).otherwise(0).alias("closing_type"),
    )


# How amounts are made of prices, and their type: as they are; what was charged, to six decimals; prices times
# a number of 23 digits, so that no amount fits a bigint.
PRICES = {"cents": MONEY, "subcent": FLOAT_MONEY, "wide": T.DecimalType(38, 2)}
WIDE_FACTOR = 10**22 + 1


def _price(prices: str) -> Column:
    if prices == "subcent":
        discount, tax = (F.col(c).cast("decimal(4,2)") for c in ("l_discount", "l_tax"))
        return (F.col("l_extendedprice").cast("decimal(11,2)") * (1 - discount) * (1 + tax)).cast(FLOAT_MONEY)
    price = F.col("l_extendedprice").cast(MONEY)
    return price if prices == "cents" else (price.cast("decimal(14,2)") * F.lit(Decimal(WIDE_FACTOR))).cast(PRICES[prices])


def _sides(prices: str) -> tuple[Column, Column]:
    """Which sides of a line are filled: (debit, credit)."""
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    price = _price(prices)
    returned = flag == "R"
    early = returned & (number <= 5)
    both = returned & (number == 6)
    debit = F.when((flag == "A") | (early & (status == "F")) | both, price)
    credit = F.when((flag == "N") | (early & (status == "O")), price).when(both, F.col("l_quantity").cast(PRICES[prices]))
    return debit, credit


def lines(lineitem: DataFrame, prices: str = "cents") -> DataFrame:
    debit, credit = _sides(prices)
    entry, account = F.col("l_orderkey"), F.col("l_partkey")
    return lineitem.select(
        F.when(entry % NO_ENTRY == 13, -entry).otherwise(entry).alias("journal_entry_id"),
        F.when(account % NO_ACCOUNT == 7, -account).otherwise(account).alias("account_id"),
        F.col("l_linenumber").alias("line_item"),
        F.concat("l_returnflag", "l_linestatus").alias("description"),
        debit.alias("debit"),
        credit.alias("credit"),
    )


def load_ledger(spark: SparkSession, sf_dir: str, prices: str = "cents", exact_names: bool = False) -> Ledger:
    """The ledger of a folder of tables, with amounts made of prices as PRICES says."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    return Ledger(
        lines=lines(table("lineitem"), prices),
        entries=entries(table("orders")),
        accounts=accounts(table("part")),
        sections=sections(table("part")),
        exact_names=exact_names,
    )
