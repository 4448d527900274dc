import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    """n words that repeat no run of five by chance."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345 + i) % (1 << 31)
        out.append(WORDS[x >> 7 & 15] + str(x >> 12 & 1023))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """doc_id and text: nulls, empty and very long texts, ties, copies, near copies, shared passages, odd characters."""
    passage, base = prose(1, 60), prose(2, 120)
    near = base.split()
    near[50] = "CHANGED"
    rows = [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One two three four"), (5, base), (6, base.upper().lower()), (7, " ".join(near)), (8, base),
        (9, prose(3, 30) + "\n" + passage + " " + prose(4, 30)), (10, passage), (11, prose(5, 10) + " " + passage), (12, "é ü ß   x \U0001f600 " + prose(6, 25)),
        (13, prose(7, 30000)), (14, "ab " * 500), (15, ("line one two\n" * 5) + prose(8, 20)), (16, "x" * 300000 + " tail"), (17, prose(9, 19)), (18, prose(10, 20)), (19, prose(10, 20)),
        (20, "!!!" + prose(11, 40).upper()), (21, "#*$%&|<> " * 30), (22, passage + " " + passage), (23, "İstanbul ǅ ẞ STRASSE " + prose(12, 40)),
    ]
    return rows + [(24 + i, prose(20 + i, 40) + (" " + base if i % 5 == 0 else "")) for i in range(16)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, i % 3, "clash") for i, t in texts], "doc_id long, text string, row int, n_words string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
