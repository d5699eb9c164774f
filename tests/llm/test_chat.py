from grantweave.llm import chat
from grantweave.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def plain(turns, block=chat.BLOCK):
    """Every view of every conversation, turn by turn."""
    out = {}
    mark = lambda s: s.replace("<|", "< |")
    convs = {}
    for c, t, role, text in turns:
        convs.setdefault(c, []).append((t, mark("unknown" if role is None else role), mark(text or "")))
    for c, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        for p in {s for _, s, _ in own} - {"system"}:
            start = 0
            for b in sorted({None if t is None else t // block for t, _, _ in own}, key=lambda x: (x is not None, x)):
                text, spans, n, mine = "", [], 0, 0
                for t, s, body in own:
                    if (None if t is None else t // block) != b:
                        continue
                    text += "<|assistant|>\n" if s == p else "<|system|>\n" if s == "system" else f'<|user name="{s}"|>\n'
                    at = len(text)
                    text += body + "<|end|>\n"
                    n += 1
                    if s == p:
                        spans.append(f"{at}-{len(text)}")
                        mine += 1
                out[c, p, b] = (start, n, mine, text, ",".join(spans))
                start += len(text)
    return out


def rows(df):
    return {(r.conv_id, r.perspective, r.block): (r.block_start, r.n_turns, r.n_target, r.text, r.spans) for r in df.collect()}


def test_query_against_plain_rendering(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op8_chat"](spark, small)) == plain(turns)


def test_edge_rows(spark):
    turns = [
        (1, 0, "Ann", "Hi"), (1, 1, "Bob", "Hello <|end|> <|assistant|>"), (1, 1, "Bob", "Hello <|end|> <|assistant|>"), (1, 1, "Ann", None),
        (1, 2, "system", "Be kind"), (1, None, "Cid", "late"), (1, 700, "Ann", "x" * 50_000), (1, 3, None, ""), (1, 4, "A<|b", "é😀"),
        (2, 0, "system", "alone"), (None, 0, "Ann", "no id"), (None, 5, "Bob", "either"), (3, -1, "Zoë", "before"), (3, 0, "Zoë", "after"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(turns, TURNS).withColumn("block", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("perspective", F.lit(2))
    assert rows(chat.perspectives(df)) == plain(turns)
    assert rows(chat.perspectives(df, block=2)) == plain(turns, 2)


def test_masks_cover_the_assistant_only(spark, small):
    for r in QUERIES["op8_chat"](spark, small).collect():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split("-"))
            assert r.text[:a].endswith("<|assistant|>\n") and r.text[a:b].endswith("<|end|>\n") and r.text[a:b].count("<|") == 1


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], TURNS)).collect() == []
