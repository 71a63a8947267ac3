EXTRA = ["kept", "score", "fp", "row", "__q_text", "__s_row", "component_id", "ids", "label"]
WORDS = "the of and to in a is that for it as was with be by on not he this are or from at an".split()


def edge_rows() -> list[tuple]:
    prose = " ".join(WORDS[i % 24] + ("x" * (i % 3)) for i in range(120))
    texts = [
        (1, "", "en"), (2, None, "en"), (3, prose, None), (None, prose, "en"), (4, prose, "en"), (4, prose, "en"),
        (5, "a\tb\n\n a b", "xx"), (6, "pass word idiot", "de"), (7, "Wort " * 30_000, "de"), (8, "x" * 60_000, "en"),
        (9, 'token = "deadbeefdeadbeefdeadbeef12" ' + prose, "en"), (None, None, None), (10, "日本語 ▁ \U0001F600", "en"),
    ]
    return [(i, t, lang, None, None if t is None else len(t), *["!"] * len(EXTRA)) for i, t, lang in texts]
