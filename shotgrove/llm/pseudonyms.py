r"""Format-preserving pseudonyms for personal data in texts, by keyed Feistel networks.

Found and validated values are permuted within their format: a card number becomes a card number with a right check
digit, a social security number a valid one, a date a date, an address of four octets another one, letters stay
letters and digits digits. The permutation
depends on the key and the kind alone, so equal values stay linked across documents while nothing is stored, and no
two values of a kind share a pseudonym. Everything is column expressions.

Kinds: payment cards (13 to 19 digits, Luhn), IPv4 addresses, phone numbers, social security numbers, dates from 1900
to 2099 (year first, or day and month first), e-mail addresses (the local part; a hash stands for one beyond ASCII), access tokens (32 or more hexadecimal
digits, or AKIA keys). What fails its validation is left alone.

Cards are looked for last, in what stands between the other values: a run of digit groups, one blank or hyphen apart,
is cut at group boundaries into the stretches that pass Luhn, usual layouts first, so years and numbers beside a card
neither hide it nor become part of it.

Defined results: NULL stays NULL, texts without values stay as they are. Values next to each other, at either end or
repeated are all replaced. Long texts are processed whole. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import free_name, let, read

# For trials only; see configured_key().
KEY = "corpus-pseudonyms"
ROUNDS = 8

PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"(?<![\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{N}])",
    "phone": (r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
              r"(?![\p{L}\p{N}])"),
    # Shapes that fail their validation would cut a card in two, so hyphens only join what can be valid.
    "ssn": (r"(?<![\p{L}\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}-])"),
    "date": (r"(?<![\p{L}\p{N}./-])(?:(?:19|20)[0-9]{2}(?:-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|"
             r"/[0-9]{2}/[0-9]{2})(?=[Tt][0-9]{2}|(?![\p{L}\p{N}/-]))|"
             r"(?:[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|"
             r"(?:0[1-9]|[12][0-9]|3[01])-(?:0[1-9]|1[0-2])-(?:19|20)[0-9]{2})(?![\p{L}\p{N}/-]))"),
    "card": r"(?<![\p{L}\p{N}-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}-])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
}
KINDS = tuple(PATTERNS)
_UNION = "|".join(PATTERNS[k] for k in KINDS if k != "card")
# Digit groups one blank or hyphen apart, however many, and what follows where it forbids an end there. Possessive, so
# that the matcher neither goes back nor goes deep.
_GROUPS = r"(?<![\p{L}\p{N}-])[0-9]++(?:[ -][0-9]++)*+[\p{L}\p{N}-]?+"
_MAYBE_CARD = r"[0-9](?:[ -]?[0-9]){12}"
# Usual layouts with one kind of separator, from a major issuer; the others are only cards where no such one is.
_LAYOUT = r"[0-9]{13,19}|" + "|".join(
    "[0-9]{4}S[0-9]{4}S[0-9]{4}S[0-9]{4}|[0-9]{4}S[0-9]{6}S[0-9]{4,5}".replace("S", sign) for sign in " -")
_USUAL = rf"^(?=[3-6]|2[2-7])(?:{_LAYOUT})$"
CARD_DIGITS = (13, 19)
# Every pattern implies one of these.
_MAYBE = r"[0-9][ .-]?[0-9]|@|AKIA[0-9A-Z]{16}|[0-9a-fA-F]{32}"

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Days from 1900-01-01 to 2099-12-31 are 17 x 4297.
_FIRST_DAY, _DAY_PARTS = "1900-01-01", (17, 4297)


def _hash(key: str, kind: str, round_: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), round_.cast("string"), other), 256)


def _byte(digest: Column, position: Column) -> Column:
    """A byte of the digest; positions beyond its 32 bytes begin anew."""
    at = (F.pmod(position - 1, F.lit(32)) * 2 + 1).cast("int")
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _shifted(half: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Every character moved within its alphabet by a byte of the digest; others stay."""
    def move(i: Column) -> Column:
        def moved(c: Column) -> Column:
            result = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                to = F.pmod(at - 1 + _byte(digest, i), F.lit(len(letters))) + 1
                result = F.when(at > 0, F.substring(F.lit(letters), to.cast("int"), F.lit(1))).otherwise(result)
            return result

        return let(F.substring(half, i, F.lit(1)), moved)

    places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, move), "")


def permuted(value: Column, kind: str, key: str = KEY, alphabets: tuple[str, ...] = _ALPHABETS,
             rounds: int = ROUNDS) -> Column:
    """A Feistel network over the characters: halves take turns in being moved by a hash of the other half."""
    cut = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"),
                     F.substring(value, cut + 1, F.length(value)).alias("b"))

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0

        def turned(half: Column, other: Column) -> Column:
            digest = _hash(key, kind, i, F.concat_ws("\x1f", F.length(value).cast("string"), other))
            return let(half, lambda h: let(digest, lambda d: _shifted(h, d, alphabets)))

        return F.when(even, F.struct(turned(state["a"], state["b"]).alias("a"), state["b"].alias("b"))).otherwise(
            F.struct(state["a"].alias("a"), turned(state["b"], state["a"]).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step,
                       lambda end: F.concat(end["a"], end["b"]))


def _number_feistel(left: Column, right: Column, sizes: tuple[int, int], kind: str, key: str, rounds: int) -> Column:
    """Feistel over Z_m x Z_n by addition; a struct (a, b)."""
    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, state["b"]).otherwise(state["a"])
        amount = F.conv(F.substring(_hash(key, kind, i, other.cast("string")), 1, 12), 16, 10).cast("bigint")
        return F.struct(F.when(even, F.pmod(state["a"] + amount, F.lit(sizes[0]))).otherwise(state["a"]).alias("a"),
                        F.when(even, state["b"]).otherwise(F.pmod(state["b"] + amount, F.lit(sizes[1]))).alias("b"))

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Luhn sum; every second digit counted from the end is doubled, the last one if `doubled_from_end` is 0."""
    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = (F.length(digits) - i - doubled_from_end) % 2 == 0
        return F.when(~double, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, b: a + b)


def refilled(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced, in order, by `digits`."""
    def char(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        nth = F.length(digits_of(F.substring(value, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), char), "")


def _card(value: Column, key: str) -> Column:
    """The first digit and the format stay, the check digit follows from the rest."""
    def changed(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), permuted(
            F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key, _ALPHABETS[:1]))
        whole = let(body, lambda b: F.concat(
            b, F.pmod(10 - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(digits, 1) % 10 == 0, let(whole, lambda w: refilled(value, w)))

    return let(digits_of(value), changed)


def _card_stretches(tokens: Column, tail: Column) -> Column:
    """Structs (first, last, text) of the cards among digit groups; every group but the last has its separator."""
    m = F.size(tokens)

    def text(i: Column, j: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(tokens, i, j - i + 1), ""), "[ -]$", "")

    def ends(i: Column) -> Column:
        return F.transform(F.sequence(i, F.least(m, i + CARD_DIGITS[1] - 1)), lambda j: F.struct(
            i.alias("first"), j.alias("last"), text(i, j).alias("text")))

    def may_end(c: Column) -> Column:
        after = F.get(tokens, c["last"] - 1)
        return F.when(c["last"] < m, after.endswith(" ")).otherwise((tail == "") & ~after.endswith("-"))

    starts = F.filter(F.sequence(F.lit(1), m), lambda i: (i == 1) | F.get(tokens, i - 2).endswith(" "))
    valid = F.filter(F.flatten(F.transform(starts, ends)), lambda c: may_end(c) & let(
        digits_of(c["text"]), lambda d: F.length(d).between(*CARD_DIGITS) & (_luhn_sum(d, 1) % 10 == 0)))

    def chosen(usual: Column, others: Column) -> Column:
        free = F.filter(others, lambda c: ~F.exists(
            usual, lambda u: (u["first"] <= c["last"]) & (u["last"] >= c["first"])))
        # Of those that begin together the longest comes first; one that overlaps the taken ones is left out.
        ordered = F.array_sort(F.concat(usual, free), lambda x, y: F.when(
            x["first"] == y["first"], y["last"] - x["last"]).otherwise(x["first"] - y["first"]))
        return F.aggregate(ordered, F.filter(ordered, lambda c: F.lit(False)), lambda taken, c: F.when(
            F.coalesce(F.get(taken, F.size(taken) - 1)["last"], F.lit(0)) < c["first"],
            F.concat(taken, F.array(c))).otherwise(taken))

    return let(valid, lambda v: let(F.filter(v, lambda c: c["text"].rlike(_USUAL)), lambda usual: let(
        F.filter(v, lambda c: ~c["text"].rlike(_USUAL)), lambda others: chosen(usual, others))))


def _without_cards(run: Column, key: str) -> Column:
    """Struct (text, n) of a run of digit groups: its cards replaced, and how many there were."""
    def written(tokens: Column, tail: Column) -> Column:
        def put(state: Column, c: Column) -> Column:
            between = F.array_join(F.slice(tokens, state["next"], c["first"] - state["next"]), "")
            sign = F.regexp_extract(F.get(tokens, c["last"] - 1), "[ -]$", 0)
            return F.struct(F.concat(state["text"], between, _card(c["text"], key), sign).alias("text"),
                            (c["last"] + 1).alias("next"), (state["n"] + 1).alias("n"))

        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"), F.lit(0).alias("n"))
        return F.aggregate(_card_stretches(tokens, tail), start, put, lambda end: F.struct(
            F.concat(end["text"], F.array_join(F.slice(tokens, end["next"], F.size(tokens)), ""), tail).alias("text"),
            end["n"].alias("n")))

    found = let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), lambda tokens: let(
        F.substring(run, F.length(F.array_join(tokens, "")) + 1, F.length(run)), lambda tail: written(tokens, tail)))
    # A hyphen at the end belongs to the last token, and forbids an end there.
    return F.when(run.rlike(_MAYBE_CARD), found).otherwise(F.struct(run.alias("text"), F.lit(0).alias("n")))


def cards_replaced(text: Column, key: str = KEY) -> Column:
    """Struct (text, n): `text`, which holds no values of other kinds, with its cards replaced, and their number."""
    def spliced(new: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(text, _GROUPS, -1), new, lambda b, n: F.concat(
            b, F.coalesce(n["text"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.aggregate(new, F.lit(0), lambda s, n: s + n["n"]).alias("n"))

    runs = F.transform(F.regexp_extract_all(text, F.lit(_GROUPS), F.lit(0)), lambda run: _without_cards(run, key))
    return F.when(text.rlike(_MAYBE_CARD), let(runs, spliced)).otherwise(
        F.struct(text.alias("text"), F.lit(0).alias("n")))


def _ipv4(value: Column, key: str) -> Column:
    def changed(octets: Column) -> Column:
        new = _number_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65536, 65536), "ipv4", key,
                              ROUNDS)
        text = let(new, lambda n: F.concat_ws(".", *[
            (part.bitwiseAND(F.lit(255)) if low else F.shiftright(part, 8)).cast("string")
            for part in (n["a"], n["b"]) for low in (False, True)]))
        return F.when(F.array_max(octets) <= 255, text)

    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), changed)


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    def changed(digits: Column) -> Column:
        new = permuted(F.substring(digits, F.length(digits) - 9, F.lit(10)), "phone", key, _ALPHABETS[:1])
        return let(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new),
                   lambda d: refilled(value, d))

    return let(digits_of(value), changed)


def _ssn(value: Column, key: str) -> Column:
    """Permuted among the valid numbers: area and group on one side, serial number on the other."""
    areas, groups, serials = 898, 99, 9999  # 001 to 899 without 666

    def written(new: Column) -> Column:
        index = F.floor(new["a"] / groups)
        area = index + F.when(index >= 665, 2).otherwise(1)
        return F.concat(*[F.lpad(part.cast("string"), width, "0") for part, width in (
            (area, 3), (F.pmod(new["a"], F.lit(groups)) + 1, 2), (new["b"] + 1, 4))])

    def changed(digits: Column) -> Column:
        area = F.substring(digits, 1, 3).cast("int")
        index = area - F.when(area > 666, 2).otherwise(1)
        new = _number_feistel(index * groups + F.substring(digits, 4, 2).cast("int") - 1,
                              F.substring(digits, 6, 4).cast("int") - 1, (areas * groups, serials), "ssn", key, ROUNDS)
        return let(let(new, written), lambda d: refilled(value, d))

    valid = ~value.rlike("^(?:000|666|9..)|^...-00|0000$")
    return F.when(valid, let(digits_of(value), changed))


def _date(value: Column, key: str) -> Column:
    sign = F.regexp_extract(value, "([./-])", 1)
    year_first = value.rlike("^[0-9]{4}")
    first, second = F.substring(value, 1, 2).cast("int"), F.substring(value, 4, 2).cast("int")
    # Day and month, unless a slash stands between and the first can be a month.
    month_first = (sign == "/") & (first <= 12)
    iso = F.when(year_first, F.translate(value, "/", "-")).otherwise(F.concat_ws(
        "-", F.substring(value, 7, 4), F.lpad(F.when(month_first, first).otherwise(second).cast("string"), 2, "0"),
        F.lpad(F.when(month_first, second).otherwise(first).cast("string"), 2, "0")))
    date = F.try_to_date(iso, "yyyy-MM-dd")
    m, n = _DAY_PARTS
    origin = F.lit(_FIRST_DAY).cast("date")

    def changed(day: Column) -> Column:
        new = _number_feistel(F.floor(day / n), F.pmod(day, F.lit(n)), (m, n), "date", key, ROUNDS)
        moved = F.date_add(origin, let(new, lambda x: (x["a"] * n + x["b"]).cast("int")))
        return F.when((day >= 0) & (day < m * n), let(moved, written))

    def written(moved: Column) -> Column:
        year, month, dom = (F.date_format(moved, p) for p in ("yyyy", "MM", "dd"))
        return (F.when(year_first, F.concat(year, sign, month, sign, dom))
                .when(month_first, F.concat(month, sign, dom, sign, year))
                .otherwise(F.concat(dom, sign, month, sign, year)))

    return let(F.datediff(date, origin), changed)


def _email(value: Column, key: str) -> Column:
    """The domain stays, and so do signs in the local part. One with other letters than ASCII becomes a keyed hash."""
    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    hashed = F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), local), 256), 1, 20)
    return F.concat(F.when(local.rlike("[^\\x00-\\x7f]"), hashed).otherwise(permuted(local, "email", key)),
                    F.substring(value, at, F.length(value)))


def _secret(value: Column, key: str) -> Column:
    hex_digits = ("0123456789", "abcdef", "ABCDEF")
    return (F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted(
        F.substring(value, F.lit(5), F.length(value)), "secret", key)))
        .otherwise(permuted(value, "secret", key, hex_digits)))


_MAKERS = {"email": _email, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card,
           "secret": _secret}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """Struct (kind, text); the kind is NULL for a value that fails its validation, the text is then the value."""
    def named(kind: str):
        return lambda text: F.struct(F.when(text.isNotNull(), F.lit(kind)).alias("kind"),
                                     F.coalesce(text, value).alias("text"))

    result = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    for kind in reversed(KINDS):
        found = let(_MAKERS[kind](value, key), named(kind))
        result = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), found).otherwise(result)
    return result


def pseudonymize(df: DataFrame, key: str = KEY, text: str = "text", out: str = "_private") -> DataFrame:
    """Replace the values in `text`; add `out`, the list of the kinds that were replaced.

    Only texts that may hold something are cut into values and what stands between them.
    """
    whole = F.col(text)
    maybe = whole.rlike(_MAYBE)
    values = F.transform(F.regexp_extract_all(whole, F.lit(_UNION), F.lit(0)), lambda v: pseudonym(v, key))
    new, between = free_name(df, "_new"), free_name(df, "_between")
    df = df.withColumn(new, F.when(maybe, values))
    df = df.withColumn(between, F.when(maybe, F.transform(
        F.split(whole, _UNION, -1), lambda piece: cards_replaced(piece, key))))
    spliced = F.array_join(F.zip_with(between, new, lambda b, n: F.concat(
        b["text"], F.coalesce(n["text"], F.lit("")))), "")
    # In the order of the text: the cards of a piece come before the value behind it.
    kinds = F.flatten(F.zip_with(between, new, lambda b, n: F.concat(
        F.array_repeat(F.lit("card"), b["n"]), F.when(n["kind"].isNotNull(), F.array(n["kind"])).otherwise(
            F.array().cast("array<string>")))))
    df = df.withColumn(out, F.coalesce(kinds, F.array().cast("array<string>")))
    return df.withColumn(text, F.when(F.size(out) > 0, spliced).otherwise(whole)).drop(new, between)


def configured_key(spark: SparkSession) -> str:
    """The key of `spark.shotgrove.pseudonyms.key`. Without it a public one is taken, which anyone can undo."""
    return spark.conf.get("spark.shotgrove.pseudonyms.key", KEY)


def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    found = pseudonymize(documents, configured_key(spark), out="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("bigint").alias("n_values"),
                        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: texts with pseudonyms; n_chars follows the text."""
    private = free_name(docs, "_private")
    found = pseudonymize(docs, configured_key(spark), out=private)
    if "n_chars" in docs.columns:
        changed = F.size(private) > 0
        found = found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
                                 .cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
