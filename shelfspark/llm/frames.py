"""Column names that nothing in a frame has yet."""

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores until `df` has no column of it, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
