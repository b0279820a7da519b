"""What the corpus tests share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0):
    """n distinct words."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
