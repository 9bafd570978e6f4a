"""Trades out of JSON payloads of several dialects: flat rows and envelopes of many trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The field names under which venues give the same thing.
ID_FIELDS = ("i", "trdMatchID", "id", "a", "trade_id")
PRICE_FIELDS = ("price", "p")
SIZE_FIELDS = ("size", "qty", "v", "q", "amount")
SIDE_FIELDS = ("side", "S", "direction")
MAKER_FIELDS = ("is_buyer_maker", "m")
TIME_FIELDS = ("T", "timestamp")


def is_array_or_object(value: Column) -> Column:
    """Whether a JSON text is an array or object; false (not null) for anything else."""
    text = F.ltrim(value)
    return F.coalesce(text.startswith("[") | text.startswith("{"), F.lit(False))


def side_of(said: Column, maker: Column) -> Column:
    """``buy``, ``sell`` or null: from the side, or from the maker flag (a buying maker means the aggressor sold)."""
    said, maker = F.lower(said), F.lower(maker)
    return F.when(said.isin("buy", "sell"), said).when(said.isNull() & (maker == "true"), "sell").when(said.isNull() & (maker == "false"), "buy")


def trade_rows(frames: DataFrame, payload: str = "payload_json", ts: str = "ts_exchange_ms", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per trade of flat and envelope frames.

    An envelope is a frame with an array or object in ``data`` or ``params.data``; each element is a
    trade with its own time, the packet's time standing in where it has none. Other frames are one
    trade each. Price and size are parsed from the text of the field (sizes as exact decimals); text
    that is no number gives null. Null or broken payloads give a row of nulls, empty arrays give
    none. One pass over the frames: a frame whose text names ``data`` is parsed once for its envelope,
    and each trade once for all its fields; no branch reads them twice, and nothing is exchanged.
    """
    body = F.col(payload)
    envelope = F.when(body.contains('"data"'), F.from_json(body, "data string, params struct<data:string>"))
    frame = frames.select(*keep, F.col(ts).alias("_packet"), body.alias("_body"), envelope.alias("_e"))
    inner = F.coalesce(*[F.when(is_array_or_object(c), F.ltrim(c)) for c in (F.col("_e.data"), F.col("_e.params.data"))])
    framed = frame.select(*keep, "_packet", "_body", inner.alias("_inner"))
    listed = F.when(F.col("_inner").startswith("["), F.col("_inner")).otherwise(F.concat(F.lit("["), "_inner", F.lit("]")))
    elements = F.coalesce(F.from_json(listed, "array<string>"), F.array())
    each = F.explode(F.when(F.col("_inner").isNotNull(), elements).otherwise(F.array("_body")))
    rows = framed.select(*keep, "_packet", F.col("_inner").isNotNull().alias("is_envelope"), each.alias("_text"))
    names = [*ID_FIELDS, *PRICE_FIELDS, *SIZE_FIELDS, *SIDE_FIELDS, *MAKER_FIELDS, *TIME_FIELDS]
    parsed = rows.withColumn("_t", F.from_json("_text", ", ".join(f"`{n}` string" for n in names)))
    first = lambda fields: F.coalesce(*[F.col(f"_t.{n}") for n in fields])
    return parsed.select(
        *keep,
        "is_envelope",
        first(ID_FIELDS).alias("trade_key"),
        F.coalesce(first(TIME_FIELDS).try_cast("bigint"), F.col("_packet")).alias("ts"),
        side_of(first(SIDE_FIELDS), first(MAKER_FIELDS)).alias("side"),
        first(PRICE_FIELDS).try_cast("double").alias("price"),
        first(SIZE_FIELDS).try_cast("decimal(38,12)").alias("size"),
    )


def without_cross_form_repeats(trades: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Envelope trades whose key also came as a flat row of the same ``scope`` (symbol) are dropped; all other rows stay.

    Ids are only unique inside a venue's symbol, so equal ids of two symbols are two trades; without
    ``scope`` the rows are taken to be those of one symbol. Flat rows
    and rows without key pass through where they lie; only envelope rows and the flat keys are
    exchanged, by scope and key, which no single value can dominate. Null scopes are equal to each other.
    """
    flat = F.col("is_envelope").eqNullSafe(F.lit(False))
    keys = trades.where(flat & F.col("trade_key").isNotNull()).select(*[F.col(c).alias(f"_f_{c}") for c in [*scope, "trade_key"]])
    same = F.col("trade_key") == F.col("_f_trade_key")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    packed = trades.where(~flat & F.col("trade_key").isNotNull()).join(keys, same, "leftanti")
    return packed.unionByName(trades.where(flat | F.col("trade_key").isNull()))


def counted_drops(trades: DataFrame, by: list[str]) -> DataFrame:
    """How many trades the plausibility filter takes and drops per group, and why."""
    price = F.col("price")
    kept = F.coalesce((price > 0) & ~F.isnan(price) & (price < float("inf")), F.lit(False))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(price.isNull()).alias("no_price"), F.count_if(price.isNotNull() & ~kept).alias("bad_price"), F.count_if(F.col("size").isNull()).alias("no_size")
    )


def plausible(trades: DataFrame) -> DataFrame:
    """Trades with a finite price above 0."""
    return trades.where("price > 0 AND NOT isnan(price) AND price < double('inf')")


def ticker_field(payload: Column, name: str) -> Column:
    """A ticker field of a bare object, a ``data`` wrapper or a ``result.list`` wrapper, as double."""
    return F.coalesce(*[F.get_json_object(payload, p + name) for p in ("$.", "$.data.", "$.result.list[0].")]).try_cast("double")


def parsed_instrument(name: Column) -> dict[str, Column]:
    """Parts of option names such as BTC-27JUN26-70000-C: underlying, expiry, strike (``d`` is the decimal point), right.

    Names of another shape, or with an impossible date, give nulls.
    """
    shape = r"^([A-Z0-9_]+)-(\d{1,2})([A-Z]{3})(\d{2})-(\d+(?:d\d+)?)-([CP])(?:-[A-Z]+)?$"
    part = lambda k: F.nullif(F.regexp_extract(name, shape, k), F.lit(""))
    months = F.create_map(*[x for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1) for x in (F.lit(m), F.lit(f"{k:02d}"))])
    day = F.concat(F.lit("20"), part(4), F.lit("-"), months[part(3)], F.lit("-"), F.lpad(part(2), 2, "0"))
    known = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    only = lambda c: F.when(known, c)
    return {
        "underlying": only(part(1)),
        "expiry": only(day),
        "strike": only(F.replace(part(5), F.lit("d"), F.lit(".")).try_cast("double")),
        "option_right": only(part(6)),
    }


def extracted_symbols(text: Column) -> Column:
    """Symbols ending in USDT or PERP named in a text, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z0-9]{2,15}(?:USDT|PERP))(?![A-Za-z0-9_])"), 1))


def announced(text: Column) -> dict[str, Column]:
    """What a notice says: its symbols, the first UTC time named in it (ms) and whether it is about an end or a start."""
    when = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}) ?UTC", 0)
    day, clock = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}) ?UTC", 1), F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}) ?UTC", 2)
    at = F.when(when != "", F.unix_millis(F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))))
    low = F.lower(text)
    kind = F.when(low.rlike("delist|will be removed"), "delisting").when(low.rlike("\\blist|launch"), "listing")
    return {"symbols": extracted_symbols(text), "at_ms": at, "category": kind}


def last_payload(frames: DataFrame, by: list[str], payload: str, ts: str, field: str) -> DataFrame:
    """The field of the last frame of each group, by (time, text); a last frame that lacks it is an error that shows it, as an unknown layout would pass for no data."""
    last = frames.groupBy(*by).agg(F.max(F.struct(ts, payload)).alias("_l"))
    text = F.col(f"_l.{payload}")
    value = ticker_field(text, field)
    shown = F.concat(F.lit(f"no {field} in "), text)
    ok = F.when(value.isNotNull(), True).otherwise(F.raise_error(shown).cast("boolean"))
    return last.where(ok).select(*by, F.col(f"_l.{ts}").alias(ts), value.alias("value"))
