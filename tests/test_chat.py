from pyspark.sql import functions as F

from reasonloom.operators import chat


def expected(messages, head=True):
    body = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in messages)
    return body + ("<|im_start|>assistant\n" if head else "")


def test_long_conversations_keep_their_order(spark):
    sizes = {1: 1, 2: 256, 3: 257, 4: 1500}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c, n in sizes.items() for t in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.prompt for r in chat.render_chat(table.repartition(9)).collect()}
    for c, n in sizes.items():
        assert got[c] == expected([(r, t) for k, _, r, t in rows if k == c])


def test_array_form_and_options(spark):
    rows = spark.createDataFrame([(1, "system", "be brief"), (2, None, None)], "turn int, role string, text string")
    messages = rows.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    got = messages.select(chat.render_messages(F.col("m"), add_generation_prompt=False)).first()[0]
    assert got == expected([("system", "be brief"), ("", "")], head=False)
    template = chat.ChatTemplate("[", "] ", "\n", "bot")
    assert messages.select(chat.render_messages(F.col("m"), template)).first()[0] == "[system] be brief\n[] \n[bot] "
