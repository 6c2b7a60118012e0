"""Chat formatting by quotation linking.

Messages are split into lines; leading '>' marks give each line's quote level. Lines at level 0 are a message's own
text; runs of lines of one deeper level, cut at blank ones, are quoted passages. Passages are normalised and hashed,
line by line and as a whole, and joined within the conversation to earlier messages: lines to equal own lines, whole
passages to the messages whose own words hold the passage's words in a row, however either is wrapped. The message
that a reply quotes most at its first level is its parent; a message that quotes nothing known follows the turn
before it. Messages are returned without quotes, in an order in which every reply follows its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, sized, stored

_QUOTE = r"^[\x20\t]*(?:>[\x20\t]*)+"
#: "On Monday, A wrote:" before a quote is part of it.
_INTRO = r"(?i)^[^>].*\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"
#: Words of the shingles by which passages find messages; a shorter passage is one shingle as a whole.
SHINGLE = 4


def normalised(line: Column) -> Column:
    """Lower case, words only, single spaces: what survives re-wrapping, quoting marks and punctuation."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of structs (level, line), in order; level counts the '>' marks of a line's head."""

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, _QUOTE, 0)
        return F.struct((F.length(head) - F.length(F.replace(head, F.lit(">"), F.lit("")))).cast("int").alias("level"), F.regexp_replace(x, _QUOTE, "").alias("line"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), one)


def _passages(ls: Column) -> Column:
    """Array of structs (level, text, hs) of lines (level, norm): the runs of one level above 0 without blank lines.

    text is the normalised passage, hs the distinct hashes of its normalised lines.
    """

    def kind(x: Column) -> Column:
        return F.when((x.level > 0) & (x.norm != ""), x.level).otherwise(0)

    at = F.sequence(F.lit(1), F.size(ls))
    starts = F.filter(at, lambda i: (i == 1) | (kind(F.get(ls, i - 1)) != kind(F.get(ls, i - 2))))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ls) + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(ls, a, b - a))
    runs = F.filter(runs, lambda r: kind(F.get(r, 0)) > 0)
    return F.transform(runs, lambda r: F.struct(F.get(r, 0).level.alias("level"), F.array_join(F.transform(r, lambda x: x.norm), " ").alias("text"), F.array_distinct(F.transform(r, lambda x: F.xxhash64(x.norm))).alias("hs")))


def _shingles(words: Column, n: Column) -> Column:
    """Distinct hashes of the runs of ``n`` words."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))))


def _passage_links(keyed: DataFrame) -> DataFrame:
    """(conv_id, q_turn, m, level, h, at): the lines of quoted passages whose words stand in a row in turn ``at``.

    Passages and messages meet by one shingle of the passage (its least hash) within the conversation, and are then
    compared as texts. Shingles are taken only of the conversations and in the lengths in which something is quoted.
    """
    wanted = keyed.select("conv_id", F.col("turn").alias("q_turn"), "m", F.explode("passages").alias("p"))
    wanted = wanted.select("conv_id", "q_turn", "m", "p.*", F.xxhash64("p.text").alias("p"))
    wanted = stored(wanted.withColumn("size", F.least(F.size(F.split("text", " ")), F.lit(SHINGLE))), "wanted")
    texts = wanted.groupBy("conv_id", "p").agg(F.first("text").alias("text"), F.first("size").alias("size"), F.max("q_turn").alias("last"))
    texts = stored(texts.withColumn("g", F.array_min(_shingles(F.split("text", " "), F.col("size")))), "passages")
    sizes = stored(texts.groupBy("conv_id", "size").agg(F.max("last").alias("last")), "sizes")
    own = keyed.where("words <> ''").select("conv_id", "turn", F.col("m").alias("own_m"), "words").join(sized(sizes), "conv_id").where("turn < last")
    own = own.select("conv_id", "turn", "own_m", "size", F.explode(_shingles(F.split("words", " "), F.col("size"))).alias("g"))
    met = stored(own.join(sized(texts.select("conv_id", "size", "g", "p")), ["conv_id", "size", "g"]).select("conv_id", "turn", "own_m", "p"), "met")
    met = met.join(texts.select("conv_id", "p", "text"), ["conv_id", "p"]).join(keyed.select(F.col("m").alias("own_m"), "words"), "own_m")
    held = met.where(F.concat(F.lit(" "), "words", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("text"), F.lit(" "))))
    latest = _latest_owners(held.select("conv_id", F.col("p").alias("h"), "turn"), wanted.select("conv_id", F.col("p").alias("h"), "q_turn"))
    out = wanted.select("conv_id", "q_turn", "m", "level", "hs", "p").join(latest.withColumnRenamed("h", "p"), ["conv_id", "p", "q_turn"])
    return out.select("conv_id", "q_turn", "m", "level", F.explode("hs").alias("h"), "at")


def _latest_owners(owners: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, h, q_turn, at): for each quoted hash the latest earlier turn that owns it, if there is one.

    owners: conv_id, h, turn; quotes: conv_id, h, q_turn. Both are put in order in ranges of (conv_id, h, turn), and a range
    starts with the last owner of those before it: a line that n messages own and n quote costs 2n rows, in any number
    of tasks.
    """
    rows = owners.select("conv_id", "h", "turn", F.lit(1).alias("own")).unionByName(quotes.select("conv_id", "h", F.col("q_turn").alias("turn"), F.lit(0).alias("own"))).distinct()
    r = stored(rows.repartitionByRange("conv_id", "h", "turn").withColumn("range", F.spark_partition_id()), "owners")
    own = F.when(F.col("own") == 1, F.struct("conv_id", "h", "turn"))
    ends = r.groupBy("range").agg(F.max(own).alias("end"))  # one row a range
    ends = ends.select("range", F.last("end", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
    w = Window.partitionBy("range").orderBy("conv_id", "h", "turn", "own").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("prev", F.last(own, True).over(w)).join(F.broadcast(ends), "range").withColumn("prev", F.coalesce("prev", "end"))
    return r.where((F.col("own") == 0) & (F.col("prev.conv_id") == F.col("conv_id")) & (F.col("prev.h") == F.col("h"))).select("conv_id", "h", F.col("turn").alias("q_turn"), F.col("prev.turn").alias("at"))


def _turns_before(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn) with before, the conversation's greatest smaller turn (null for its first).

    Looks back within ranges of (conv_id, turn), which cut long conversations; a range's first row takes the last one
    of the range before it.
    """
    r = stored(turns.repartitionByRange("conv_id", "turn").withColumn("range", F.spark_partition_id()), "ranges")
    ends = r.groupBy("range").agg(F.max(F.struct("conv_id", "turn")).alias("end"))  # one row a range
    ends = ends.select(F.col("range"), F.lag("end").over(Window.orderBy("range")).alias("end"))
    w = Window.partitionBy("range").orderBy("conv_id", "turn")
    r = r.withColumn("prev", F.lag(F.struct("conv_id", "turn")).over(w)).join(F.broadcast(ends), "range")
    prev = F.coalesce("prev", "end")
    return r.select("conv_id", "turn", F.when(prev.conv_id == F.col("conv_id"), prev.turn).alias("before"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per distinct message (conv_id, turn, role, text) its own text and its place in the conversation.

    Returns conv_id, turn, role, text (own lines without quotes and quote introductions), n_quoted (quoted lines that
    are not blank), n_linked (of those, lines found in earlier messages), max_level, parent_turn (null at the start
    of a conversation), root_turn and depth. Sorted by conv_id, root_turn, turn, replies follow their parents.

    A quoted line is found in a message that has it as a line of its own, or that holds the whole words of the line's
    passage in a row (so a re-wrapped paragraph, or a part of a line, is found). Words are runs of letters and digits.

    Equal rows are one message. Messages that share conv_id and turn are separate, with the same parent. A quoted
    line or passage that several earlier messages own counts for the latest of them, and so do ties. Rows without conv_id or
    turn keep their text and have no links. Null texts are empty. Conversations are never gathered in one task:
    links are joins on (conv_id, hash) of distinct lines and shingles, and depths come from pointer doubling. Other
    columns are ignored.
    """
    m = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    m = m.withColumn("m", F.xxhash64("conv_id", "turn", "role", "text"))
    m = m.withColumn("ls", F.transform(parsed_lines(F.col("text")), lambda x: F.struct(x.level.alias("level"), x.line.alias("line"), normalised(x.line).alias("norm"))))
    m = m.withColumn("own", F.filter("ls", lambda x, i: (x.level == 0) & ~(x.line.rlike(_INTRO) & (F.coalesce(F.get("ls", i + 1).level, F.lit(0)) > 0))))
    said = F.filter(F.transform("own", lambda x: x.norm), lambda x: x != "")
    m = m.select(
        "conv_id", "turn", "role", "m",
        F.trim(F.regexp_replace(F.array_join(F.transform("own", lambda x: x.line), "\n"), r"\n{3,}", "\n\n")).alias("own"),
        F.array_distinct(said).alias("lines"), F.array_join(said, " ").alias("words"),
        F.transform(F.filter("ls", lambda x: (x.level > 0) & (x.norm != "")), lambda x: F.struct(x.level.alias("level"), F.xxhash64(x.norm).alias("h"))).alias("quotes"),
        _passages(F.col("ls")).alias("passages"),
    )
    m = stored(m, "messages")
    keyed = m.where("conv_id is not null and turn is not null")
    wanted = keyed.select("conv_id", "turn", "m", F.explode("quotes").alias("q")).select("conv_id", F.col("turn").alias("q_turn"), "m", "q.*").distinct()
    lines = keyed.select("conv_id", "turn", F.explode("lines").alias("l")).select("conv_id", "turn", F.xxhash64("l").alias("h")).distinct()
    latest = _latest_owners(lines, wanted.select("conv_id", "h", "q_turn"))
    links = wanted.join(latest, ["conv_id", "h", "q_turn"]).select("conv_id", "q_turn", "m", "level", "h", "at")
    links = stored(links.unionByName(_passage_links(keyed)).distinct(), "links")
    votes = links.groupBy("m", "at").agg(F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("first"), F.count("*").alias("n"))
    parent = votes.groupBy("m").agg(F.max(F.struct("first", "n", "at")).alias("best")).select("m", F.col("best.at").alias("quoted_turn"))
    linked = links.select("m", "level", "h").distinct().groupBy("m").agg(F.count("*").alias("n_linked"))
    before = _turns_before(keyed.select("conv_id", "turn").distinct())
    m = m.join(parent, "m", "left").join(linked, "m", "left").join(before, ["conv_id", "turn"], "left")
    m = m.withColumn("parent_turn", F.coalesce("quoted_turn", "before"))
    m = stored(m.drop("lines", "words", "passages", "quoted_turn", "before"), "messages")

    # a turn's place is that of the message of it with the earliest parent; parents are always earlier turns
    up = m.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"))
    up = stored(up.select("conv_id", "turn", F.coalesce("up", "turn").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "parents")
    up = up.withColumn("done", F.col("up") == F.col("turn"))
    while True:  # only turns whose root is still open are joined again
        far = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("done").alias("root"))
        ahead = up.where("not done").join(far, ["conv_id", "up"]).select("conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("root") | (F.col("up2") == F.col("up"))).alias("done"))
        nxt = stored(up.where("done").unionByName(ahead), "parents")
        drop_stored(up)
        up = nxt
        if up.where("not done").isEmpty():
            break
    out = m.join(up.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("depth").cast("long").alias("depth")), ["conv_id", "turn"], "left")
    levels = F.array_max(F.transform("quotes", lambda q: q.level))
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), F.when(F.col("quotes").isNull(), 0).otherwise(F.size("quotes")).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce(levels, F.lit(0)).cast("long").alias("max_level"), "parent_turn", "root_turn", "depth")


def chat_pieces(linked: DataFrame, turns: int = 256, extra: tuple[str, ...] = ()) -> DataFrame:
    """Conversations as chat records: conv_id, root_turn, piece and messages, an array of (turn, role, content, extra...).

    A piece holds the messages of ``turns`` consecutive turn numbers of one thread, so no task gathers an
    unbounded conversation; ordered by conv_id, root_turn and piece, the pieces are the conversations. Messages
    without own text are left out. ``extra`` names further columns of ``linked`` that stay with each message.
    """
    rows = linked.where("text <> '' and conv_id is not null and turn is not null")
    rows = rows.withColumn("piece", F.floor(F.col("turn") / turns).cast("long"))
    msgs = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), *extra)))
    return rows.groupBy("conv_id", "root_turn", "piece").agg(msgs.alias("messages"))


def conversations(messages: DataFrame) -> DataFrame:
    """The chat pieces' messages as rows: conv_id, root_turn, piece, position (in the piece, from 0), turn, role, content,
    n_quoted, n_linked, max_level, parent_turn and depth."""
    pieces = chat_pieces(link_quotes(messages), extra=("n_quoted", "n_linked", "max_level", "parent_turn", "depth"))
    return pieces.select("conv_id", "root_turn", "piece", F.posexplode("messages").alias("position", "x")).select("conv_id", "root_turn", "piece", "position", "x.*")
