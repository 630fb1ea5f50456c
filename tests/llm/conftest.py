import pytest

SF = "/root/testdata/sf0.001"
CONTROL = "<|endoftext|>"
LONG = "lorem ipsum dolor sit amet, " * 9000


def edge_texts():
    """Null, empty, blank, odd characters, repeats, control strings and a very long text."""
    return [None, "", " ", "\n\t  \n", "a", "Hello  world\r\n\r\nagain 'tis don't 123456", "naïve Ünïcode 中文字 🙂 é \x1c  x", "Same text here",
            "Same text here", f"x{CONTROL} y {CONTROL}{CONTROL}<|", "word " * 500, "ÀÉ Aİ", LONG, "...!!! ,,, 's 'S it's", "tail space  "]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(k, t, "en", "s", 7, "clash", 1.5) for k, t in enumerate(edge_texts())] + [(3, "\n\t  \n", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, word string, score double")


def write_tables(folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
