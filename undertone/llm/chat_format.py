"""Chat formatting with Spark expressions only.

A conversation becomes one text:

    ### user
    first text<+>next text of the same role</turn>
    ### assistant
    answer</turn>

Adjacent turns of one role share a header; ``<+>`` keeps their border. Inside texts and roles every
backslash and control string is replaced by a backslash and a letter, so no text can look like a
control string, and replacing back gives the text again. The loss mask lists the spans of the
assistants' texts in code points of the formatted text.
"""

from pyspark.sql import DataFrame, functions as F

HEADER, JOIN, END = "### ", "<+>", "</turn>\n"
# Control strings and what stands for them. The backslash comes first when escaping
# and last when reading back.
CODES = [("\\", "\\s"), ("</turn>", "\\e"), ("### ", "\\h"), ("<+>", "\\j")]
ROLE_CODES = [*CODES, ("\n", "\\n")]
LEARNED_ROLE = "assistant"


def escaped(text, codes=CODES):
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text, codes=CODES):
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def exactly(text):
    """A pattern for ``split`` that matches just this text."""
    return "\\Q" + text + "\\E"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and length in code points) per conversation.

    Turns are ordered by turn, then role, then text. Null texts and roles are empty; null turns
    come first; rows without a conv_id form one conversation. Repeated rows are turns. The formatted
    text is one value, so a conversation is as long as a value may be. An empty table gives none.
    """
    turns = conversations.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def piece(turn, i):
        before = F.get("_turns", i - 1)["role"]
        header = F.concat(F.lit(HEADER), escaped(turn["role"], ROLE_CODES), F.lit("\n"))
        lead = F.when(i == 0, header).when(before == turn["role"], F.lit(JOIN)).otherwise(F.concat(F.lit(END), header))
        return F.struct(lead.alias("lead"), escaped(turn["text"]).alias("body"), (turn["role"] == LEARNED_ROLE).alias("learned"))

    grouped = grouped.select("conv_id", F.transform("_turns", piece).alias("_pieces"))
    nothing = F.array().cast("array<struct<start:int,length:int>>")

    def add(done, piece):
        start = done["chars"] + F.length(piece["lead"])
        size = F.length(piece["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("chars"),
                        F.when(piece["learned"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    spans = F.aggregate("_pieces", F.struct(F.lit(0).alias("chars"), nothing.alias("spans")), add)["spans"]
    text = F.concat_ws("", F.flatten(F.transform("_pieces", lambda p: F.array(p["lead"], p["body"]))))
    return grouped.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted):
    """The turns (role, text) of a formatted text."""
    blocks = F.split(formatted, exactly(END))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block):
        end = F.instr(block, "\n")
        role = unescaped(F.substring(block, F.lit(len(HEADER) + 1), end - len(HEADER) - 1), ROLE_CODES)
        body = F.substring(block, end + 1, F.length(block))
        return F.transform(F.split(body, exactly(JOIN)),
                           lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_learned(formatted, spans):
    """All text under the loss mask, read back."""
    return F.concat_ws("", F.transform(
        spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, told from these texts and masks alone."""
    read = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"),
        read_learned(F.col("formatted"), F.col("loss_spans")).alias("_learned"))
    whole = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
