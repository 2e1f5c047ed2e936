"""Narration text: cells to amounts and dates, noise removal, payment rails, rules and merchant names.

Everything is an expression over columns; what cannot be read becomes null instead of an error. Patterns use \\h for blanks
within a line where the cells hold no line breaks any more.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_MERCHANT_RAILS
from .similarity import token_set_score

#: All but capitals, digits and the space. Java tests a class of single characters by a table, which ranges in it would prevent.
NOT_PLAIN = "[^ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ]+"
BLANKS = "[\\s   ]+"

# Patterns of statement cells.
CURRENCY = r"[₹$]|(?i)(?<![A-Za-z])(?:rs|inr)\.?(?![A-Za-z])"
DEBIT_MARK = r"(?i)\b(?:d\.?r\.?|dr|debit)\b\.?$"
CREDIT_MARK = r"(?i)\b(?:c\.?r\.?|cr|credit)\b\.?$"
EMPTY_CELLS = ("", "-", "--", "—", "N/A", "NIL")
DATE_FORMATS = (
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy", "d MMM yyyy", "d-MMM-yyyy", "d/MMM/yyyy", "d MMMM yyyy",
    "d MMM yy", "d-MMM-yy", "d/MMM/yy", "yyyy-M-d", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "ddMMMyyyy", "ddMMMyy",
)
YEARLESS_FORMATS = ("d MMM yyyy", "d-MMM yyyy", "d/MMM yyyy", "d MMMM yyyy", "d/M yyyy", "d-M yyyy")
LEADING_DATE = r"^\s*(\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2,4})"
MASKED_CARD = r"\b\d{0,6}[Xx*]{4,12}\d{2,4}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
LONG_DIGITS = r"\b\d{8,}\b"
SEPARATORS = r"[\-/|:,]{2,}"
EDGES = r"^[\s\-/|:,.]+|[\s\-/|:,.]+$"

# Rails by the first pattern that the narration has.
RAILS = (
    ("upi", r"^\s*upi\b|^\s*upiar\b|\bupi[/\-]"),
    ("card", r"^\s*(?:pos|vps|ecom|ecomm|ips|card)\b"),
    ("atm", r"^\s*(?:atw|nwd|cwd|atd|atm)\b|\batm\s+(?:cash|wdl|withdrawal)\b"),
    ("neft", r"^\s*neft\b|\bneft[/\-]"),
    ("imps", r"^\s*(?:imps|mmt)\b|\bimps[/\-]"),
    ("rtgs", r"^\s*rtgs\b|\brtgs[/\-]"),
    ("cheque", r"^\s*(?:chq|cheque|clg|cts|micr)\b"),
    ("nach", r"^\s*(?:nach|ecs)\b"),
    ("ach", r"^\s*ach\b"),
    ("netbanking", r"^\s*(?:inb|ib|netbanking|bil|billpay|onl)\b"),
    ("cash", r"^\s*(?:cash|csh)\b|\bcash\s+dep"),
)

# Tokens that name no merchant, in two lists: rails, fillers and banks; and cities.
FILLER_TOKENS = """
UPI POS VPS ECOM ECOMM IPS CARD NEFT IMPS MMT RTGS ATW NWD CWD ATD ATM CHQ CHEQUE CLG CTS MICR NACH ECS ACH INB IB NETBANKING BIL
BILLPAY ONL CASH CSH DR CR DEBIT CREDIT PAYMENT PAYMNT PMT PAY PAID TRANSFER TRF TXN TRANSACTION REF REFNO UTR RRN TID MID BATCH
SEQ AUTH APPROVAL ORDER PURCHASE REVERSAL REFUND CHARGE CHARGES CHG FEE FEES GST IGST CGST SGST TAX TDS INT INTEREST OPENING
CLOSING BALANCE B/F C/F BF CF TO FROM VIA FOR AND THE OF AT IN SELF OWN ACCOUNT AC ACCT A/C NO NUMBER BRANCH BANK LTD LIMITED PVT
PRIVATE BY INDIA INR RS COLLECT REQUEST MANDATE SI STANDING INSTRUCTION AUTOPAY HDFC ICICI SBI AXIS KOTAK IDFC INDUSIND YES YESB
PNB BOB CANARA UNION IDBI YBL OKAXIS OKICICI OKHDFCBANK OKSBI PAYTM IBL AXL UBIN SBIN PYTM APL SUCCESS SUCCESSFUL FAILED PENDING
REVERSED P2A P2M P2P MB INET NET ONLINE OTHPG MIR CC WDL DEP DEPOSIT WITHDRAWAL SALARY RENT EMI ALERT ALERTS SMS CAPITALISED
CAPITALIZED DEDUCTED THANK YOU RECEIVED ICIC HDFCBANK SBIN0 UTIB0 KKBK IDFB INDB SHCB
""".split()
CITY_TOKENS = """
MUMBAI DELHI NEWDELHI BANGALORE BENGALURU HYDERABAD CHENNAI KOLKATA PUNE AHMEDABAD JAIPUR LUCKNOW SURAT KANPUR NAGPUR INDORE THANE
BHOPAL VISAKHAPATNAM PATNA VADODARA GHAZIABAD LUDHIANA AGRA NASHIK FARIDABAD MEERUT RAJKOT GURGAON GURUGRAM NOIDA MYSORE MYSURU
COIMBATORE KOCHI COCHIN CHANDIGARH
""".split()
STOP_TOKENS = FILLER_TOKENS + CITY_TOKENS

# Rules in order: code, category, movement, whether it is spending, whether a merchant is dropped, pattern.
RULES = (
    ("credit_card_payment", "credit_card_payment", "credit_card_payment", False, True, r"\bcredit\s*card\b|\bcc\s*(?:payment|bill|pmt)\b|\bcard\s*payment\b|billpay.*\bcc\b|\bpayment\s+received\b|\bcc\s*-\s*\d|\bcc\b(?=\s*-)"),
    ("cash_withdrawal", "cash_withdrawal", "cash_withdrawal", False, True, r"\batw\b|\bnwd\b|\bcwd\b|\batd\b|cash\s*wdl|atm\s*(?:cash|wdl|withdrawal)|cash\s*withdrawal|\batm\b\s*[-/]|by\s+cash\s+wdl|cash\s+advance"),
    ("self_transfer", "transfers", "transfer", False, False, r"\bself\b|own\s+account|transfer\s+to\s+own|\bsweep\b|\blien\b"),
    ("salary", "salary", "salary", False, False, r"\bsalary\b|\bsal\s*cr\b|\bpayroll\b|\bwages\b|salary\s*credit"),
    ("refund", "refund", "refund", False, False, r"\brefund\b|\breversal\b|\breversed\b|\bchargeback\b|\bcashback\b"),
    ("interest_credit", "other", "income", False, True, r"credit\s+interest|interest\s+capitalis|int\.?\s*cr\b|savings?\s+interest|\bint\s+pd\b"),
    ("bank_charges", "bank_charges", "bank_charge", True, True, r"sms\s*alert|\bamb\s*(?:chg|charge)|service\s*charge|min(?:imum)?\s*bal|\bcharges?\b|\bchg\b|\bpenalty\b|annual\s*fee|\bgst\s+on\b|processing\s*fee|late\s*(?:payment\s*)?fee|finance\s*charge|cheque\s*return|\bdebit\s*card\s*fee"),
    ("taxes", "taxes", "expense", True, True, r"\btds\b|income\s*tax|advance\s*tax|\bgst\s*payment\b|self\s*assessment"),
    ("emi", "emi", "emi", True, False, r"\bemi\b|loan\s*(?:repay|instal|emi)|equated\s*monthly|\bhdb\s*financial|bajaj\s*fin|\bhome\s*loan\b|\bauto\s*loan\b|\bpersonal\s*loan\b"),
    ("investment", "investment", "investment", False, False, r"\bsip\b|mutual\s*fund|\bmf\s*purchase|\bnps\b|\bppf\b|recurring\s*deposit|\bfd\s*(?:booking|created)|zerodha|groww|\bcoin\b\s*mf"),
    ("insurance", "insurance", "expense", True, False, r"\blic\b|life\s*insurance|health\s*insurance|\bpolicy\s*premium\b|insurance\s*premium|\bhdfc\s*life\b|\bmax\s*life\b"),
    ("rent", "rent", "expense", True, False, r"\brent\b|house\s*rent|\brental\b|maintenance\s*charge|society\s*maint"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Line breaks and runs of blanks become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), BLANKS, " "))


def strip_machine_noise(c: Column | str) -> Column:
    """Without masked cards, bank codes, long digit runs and runs of separators, in that order."""
    text = collapse(c)
    for pattern in (MASKED_CARD, IFSC, LONG_DIGITS, SEPARATORS):
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(F.regexp_replace(text, BLANKS, " "), EDGES, "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _cell(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), CURRENCY, ""), BLANKS, " "))


def _signed(text: Column) -> Column:
    wrapped = text.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, F.trim(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    inner = F.trim(F.regexp_replace(F.regexp_replace(inner, CREDIT_MARK, ""), DEBIT_MARK, ""))

    def valued(body: Column) -> Column:
        digits = F.regexp_replace(F.when(body.rlike("-$"), F.regexp_replace(body, "-$", "")).otherwise(F.regexp_replace(body, "^[-+]", "")), "[, ]", "")
        value = F.bround(digits.try_cast("decimal(30,10)"), 2).cast("decimal(18,2)")
        return F.when(body.rlike("-$|^-") != wrapped, -value).otherwise(value)

    return F.when(~text.isin(*EMPTY_CELLS), _let(inner, valued)).cast("decimal(18,2)")


def parse_amount(c: Column | str) -> Column:
    """The signed amount of a cell: parentheses and leading or trailing minus are negative; Dr and Cr carry no sign here."""
    return _let(_cell(c), _signed)


def amount_direction(c: Column | str, default: str | None = None) -> Column:
    """debit or credit of a cell by its mark, else by its sign, else the default; null where nothing says."""

    def way(text: Column) -> Column:
        by_sign = lambda v: F.when(v < 0, F.lit("debit")).when(v.isNotNull(), F.lit(default))
        return F.when(text.rlike(CREDIT_MARK), "credit").when(text.rlike(DEBIT_MARK), "debit").otherwise(_let(_signed(text), by_sign))

    return F.when(parse_amount(c).isNotNull(), _let(_cell(c), way))


def parse_date(c: Column | str, year_hint: int | None = None) -> Column:
    """The date of a cell, always day first; a hint gives the year only where the cell has none. Two-digit years are 1969 to 2068."""

    def tried(text: Column) -> Column:
        found = []
        for f in DATE_FORMATS:
            day = F.try_to_date(text, f)
            if "yyyy" not in f:
                day = _let(day, lambda d: F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d))
            found.append(F.when(text.rlike(_shape(f)), day))
        if year_hint is not None:
            found += [F.when(text.rlike(_shape(f.removesuffix(" yyyy"))), F.try_to_date(F.concat(text, F.lit(f" {year_hint}")), f)) for f in YEARLESS_FORMATS]
        return F.coalesce(*found)

    return _let(F.initcap(F.regexp_replace(collapse(c), ",$", "")), tried)


def _shape(fmt: str) -> str:
    """What a text of the format looks like; Spark's parser alone is less strict about the number of digits."""
    marks = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{4,9}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "dd": r"\d{1,2}", "d": r"\d{1,2}", ".": r"\."}
    return "^" + re.sub(r"y+|M+|d+|\.", lambda m: marks[m[0]], fmt) + "$"


def leading_date(c: Column | str) -> Column:
    """The date token that a line starts with, where it is a date."""
    token = F.regexp_extract(_col(c), LEADING_DATE, 1)
    return F.when((token != "") & parse_date(token).isNotNull(), token)


def payment_rail(c: Column | str) -> Column:
    found = F.lit("unknown")
    for name, pattern in reversed(RAILS):
        found = F.when(_col(c).rlike(f"(?i){pattern}"), name).otherwise(found)
    return found


def narration_rule(c: Column | str) -> Column:
    """The first rule that the narration meets, as a struct; null where none does."""
    found = F.lit(None)
    for code, category, movement, spending, drops, pattern in reversed(RULES):
        rule = F.struct(
            F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(movement).alias("movement"),
            F.lit(spending).alias("is_expense"), F.lit(drops).alias("drops_merchant"),
        )
        found = F.when(_col(c).rlike(f"(?i){pattern}"), rule).otherwise(found)
    return found


def haystack(c: Column | str) -> Column:
    """Upper case, with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(collapse(c)), NOT_PLAIN, " "), " {2,}", " "))


def residue(c: Column | str, stops: list[str] | None = None) -> Column:
    """What may name the merchant: tokens that are no stop token, no digits, and hold no run of four digits."""
    words = F.filter(F.split(haystack(strip_machine_noise(c)), " "), lambda w: (F.length(w) > 1) & ~w.isin(*(stops or STOP_TOKENS)) & ~w.rlike(r"^\d+$|\d{4,}"))
    return F.array_join(words, " ")


def split_tokens(c: Column | str) -> Column:
    """The fields of a narration, by the separators between them."""
    parts = F.split(collapse(c), r"[/|\\]+|\s+-\s+|(?<=[A-Za-z0-9])-(?=[A-Za-z])")
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def upi_name(c: Column | str) -> Column:
    """The local part of the first payment address that names somebody: not digits alone or for the most part."""
    tokens = F.filter(F.split(collapse(c), r"[\s/|\\\-]+"), lambda t: t.rlike(r"^[^@]*@[A-Za-z]{2,20}$"))
    names = F.transform(tokens, lambda t: F.trim(F.regexp_replace(F.substring_index(t, "@", 1), "[._]+", " ")))
    digits = lambda n: F.length(F.regexp_replace(n, r"\D", ""))
    return F.get(F.filter(names, lambda n: (n != "") & (digits(n) * 2 <= F.length(n)) & ~n.rlike(r"^\d+$")), 0)


def titled(c: Column | str) -> Column:
    """Words of letters alone with a capital first; 255 characters at most."""
    words = F.transform(F.split(_col(c), " "), lambda w: F.when(w.rlike(r"^\p{L}+$"), F.initcap(w)).otherwise(w))
    return F.substring(F.array_join(words, " "), 1, 255)


def normalize_merchants(rows: DataFrame, aliases: DataFrame, key: str, text: str = "description", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Adds rail, merchant, slug, merchant_confidence and merchant_match to rows with a unique key.

    aliases: alias, slug, name. The longest alias that a narration holds as whole words names the merchant (0.99), else
    the longest that its payment address holds (0.97); rails without merchants say so (0.90); else the alias most like what is
    left of the narration (0.75 to 0.95); else what is left is shown as a name (0.50) or nothing is (0.30). Aliases join by
    their words: each narration meets only aliases whose first word it has, so neither side is compared with all of the other.

    keep(rows, name) may store the rows with what their own words say, which are read again and again for the names that are left.
    """
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.upper("alias"), "[^A-Z0-9 ]+", " "), r"\s+", " "))
    aliases = aliases.select(flat.alias("alias"), "slug", "name").where("alias <> ''").withColumn("word", F.substring_index("alias", " ", 1))

    # The narration's words and its address's in one pass, so that rows meet their aliases over one exchange.
    hays = F.array(F.struct(F.lit(True).alias("whole"), haystack(text).alias("hay")), F.struct(F.lit(False).alias("whole"), haystack(F.coalesce(upi_name(text), F.lit(""))).alias("hay")))
    words = rows.select(key, F.inline(F.filter(hays, lambda h: h["hay"] != "")))
    words = words.select(key, "whole", "hay", F.explode(F.array_distinct(F.split("hay", " "))).alias("word"))
    hits = words.join(aliases, "word").where(F.contains(F.concat(F.lit(" "), "hay", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" "))))
    hit = F.struct((-F.length("alias")).alias("less"), "alias", "slug", "name")
    best = hits.groupBy(key).agg(F.min(F.when(F.col("whole"), hit)).alias("hit"), F.min(F.when(~F.col("whole"), hit)).alias("vpa"))
    rows = rows.join(best, key, "left").withColumn("rail", payment_rail(text))
    no_merchant = F.col("hit").isNull() & F.col("rail").isin(*NO_MERCHANT_RAILS)
    open_ = F.col("hit").isNull() & ~no_merchant & F.col("vpa").isNull()
    rows = rows.withColumn("hay", F.when(open_, F.nullif(residue(text), F.lit(""))))
    rows = keep(rows, "narrations") if keep else rows
    named = aliases.groupBy("alias").agg(F.min(F.struct("slug", "name")).alias("of"))
    like = fuzzy_matches(rows.where("hay is not null").select("hay").distinct(), aliases.select("alias", "slug")).join(named, "alias")
    like = like.select("hay", F.struct("of.slug", "of.name", "score").alias("like"))
    # Rows without a name that is left need not move; in the join they would all be one key's.
    rest = rows.where("hay is null").withColumn("like", F.lit(None).cast(like.schema["like"].dataType))
    rows = rows.where("hay is not null").join(like, "hay", "left").unionByName(rest)
    left = titled(F.coalesce("hay", upi_name(text), F.lit("")))

    def case(alias, rail, address, fuzzy, rest):
        found = F.when(F.col("hit").isNotNull(), alias).when(no_merchant, rail).when(F.col("vpa").isNotNull(), address)
        return found.when(F.col("like").isNotNull(), fuzzy).otherwise(rest)

    null = F.lit(None).cast("string")
    return rows.withColumns(
        {
            "merchant": case(F.col("hit.name"), null, F.col("vpa.name"), F.col("like.name"), F.nullif(left, F.lit(""))),
            "slug": case(F.col("hit.slug"), null, F.col("vpa.slug"), F.col("like.slug"), null),
            "merchant_confidence": case(F.lit(0.99), F.lit(0.90), F.lit(0.97), fuzzy_confidence(F.col("like.score")), F.when(left != "", 0.50).otherwise(0.30)),
            "merchant_match": case(F.lit("dictionary_alias"), F.lit("no_merchant_for_rail"), F.lit("upi_handle"), F.lit("fuzzy"), F.lit("unmatched_residue")),
        }
    ).drop("hit", "vpa", "hay", "like")


def enriched(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds category, category_source, movement and is_expense to rows with description, direction and a merchant's slug.

    categories: slug, merchant_category. The narration rule goes before the merchant's category; without either the
    category is null, and the direction alone says whether it is spending.
    """
    rows = rows.join(categories, "slug", "left").withColumn("_rule", narration_rule("description"))
    ruled, known = F.col("_rule").isNotNull(), F.col("merchant_category").isNotNull()
    out = F.col("direction") == "debit"
    return rows.withColumns(
        {
            "category": F.coalesce("_rule.category", "merchant_category"),
            "category_source": F.when(ruled, "deterministic_rule").when(known, "verified_merchant_rule").otherwise("fallback_other"),
            "movement": F.coalesce("_rule.movement", F.when(out, "expense").otherwise("income")),
            "is_expense": F.coalesce(F.col("_rule.is_expense"), out),
            "merchant": F.when(~F.coalesce(F.col("_rule.drops_merchant"), F.lit(False)), F.col("merchant")),
        }
    ).drop("_rule", "merchant_category")


FUZZY_FLOOR = 0.88
SHORT = 6
#: Confidence of a fuzzy match at the floor, and what a perfect score adds.
FUZZY_CONFIDENCE, FUZZY_SPAN = 0.75, 0.20


def _parts(frame: DataFrame, name: str, parts: Column, counts: DataFrame) -> DataFrame:
    """name and its parts (n: occurrences in counts, part), the rarest first."""
    rows = frame.select(name, F.explode(parts).alias("part")).join(counts, "part", "left")
    rows = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))).alias("parts"))
    return rows


def _counts(frame: DataFrame, parts: Column) -> DataFrame:
    return frame.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def _joined_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(-1), lambda n, w: n + F.char_length(w) + 1)


def fuzzy_candidates(names: DataFrame, aliases: DataFrame, floor: float = FUZZY_FLOOR) -> DataFrame:
    """Pairs of hay and alias, among them all whose score reaches the floor.

    A score is the best of three ratios r = 2 * common / (lengths) of texts of distinct words. Where two whole texts of n and
    m characters reach the floor, their common subsequence breaks up in n + m - 2 * common places at most, so that of their
    words' padded pairs of letters (n + 1 and m + 1, whatever the words' order) a number in proportion to n is common:
    pairs meet by their rarest letter pairs, as many as leave fewer than that. Where the shared words reach the
    floor against one side, they are floor / (2 - floor) of its length: pairs meet by the rarest words of one side, as many
    as leave less than that, and by all words of the other.
    """
    cover = floor / (2 - floor)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))

    def pairs_of_letters(c: str) -> Column:
        """Letter pairs of the padded words, the second of equal ones apart from the first."""
        padded = F.transform(words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, 2))))
        nth = lambda g, i: F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")
        return F.transform(grams, lambda g, i: F.concat(g, nth(g, i)))

    def rarest(frame: DataFrame, name: str, counts: DataFrame) -> DataFrame:
        """The words without which the others are too short to reach the floor."""
        rows = _parts(frame, name, words(name), counts)
        rest = lambda i: _joined_length(F.transform(F.slice("parts", i + 1, F.size("parts")), lambda p: p["part"]))
        whole = _joined_length(F.transform("parts", lambda p: p["part"]))
        return rows.select(name, F.explode(F.filter("parts", lambda _, i: rest(i) >= cover * whole - 1e-6)).alias("p")).select(name, "p.part")

    def prefix(frame: DataFrame, name: str, counts: DataFrame) -> DataFrame:
        """The rarest letter pairs, as many as leave fewer than linked texts have in common."""
        rows = _parts(frame, name, pairs_of_letters(name), counts)
        n = F.size("parts") - 1
        least = F.ceil(n * ((1 + cover) * (0.5 - 1.5 * (1 - floor))) + 1 - 1e-6)
        return rows.select(name, F.explode(F.slice("parts", F.lit(1), F.size("parts") - least.cast("int") + 1)).alias("p")).select(name, "p.part")

    left, right = names.select("hay").distinct().where("hay <> ''"), aliases.select("alias").distinct().where("alias <> ''")
    all_left, all_right = left.select("hay", F.explode(words("hay")).alias("part")), right.select("alias", F.explode(words("alias")).alias("part"))
    of_left, of_right, grams = _counts(left, words("hay")), _counts(right, words("alias")), _counts(right, pairs_of_letters("alias"))
    met = rarest(left, "hay", of_right).join(all_right, "part").select("hay", "alias")
    met = met.unionByName(all_left.join(rarest(right, "alias", of_left), "part").select("hay", "alias"))
    return met.unionByName(prefix(left, "hay", grams).join(prefix(right, "alias", grams), "part").select("hay", "alias")).distinct()


def fuzzy_matches(names: DataFrame, aliases: DataFrame, floor: float = FUZZY_FLOOR) -> DataFrame:
    """hay, alias, slug and score of the alias most like each name, from the floor on; of equals the longest, then the first.

    If the best one is short, or the name is, they must hold each other, or the name has no match. Names meet by parts that
    pairs over the floor must share, so no name is compared with all aliases and none is lost.
    """
    scored = fuzzy_candidates(names, aliases, floor).withColumn("score", token_set_score("hay", "alias")).where(F.col("score") >= floor)
    best = scored.groupBy("hay").agg(F.min(F.struct((-F.col("score")).alias("less"), (-F.char_length("alias")).alias("length"), "alias")).alias("b"))
    best = best.select("hay", "b.alias", (-F.col("b.less")).alias("score"))
    short = (F.char_length("hay") <= SHORT) | (F.char_length("alias") <= SHORT)
    slugs = aliases.groupBy("alias").agg(F.min("slug").alias("slug"))
    return best.where(~short | F.contains("hay", "alias") | F.contains("alias", "hay")).join(slugs, "alias").select("hay", "alias", "slug", "score")


def fuzzy_confidence(score: Column, floor: float = FUZZY_FLOOR) -> Column:
    """From 0.75 at the floor to 0.95."""
    return F.round(FUZZY_CONFIDENCE + (score - floor) / (1 - floor) * FUZZY_SPAN, 3)
