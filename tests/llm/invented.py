"""Invented text for tests."""


def sentence(k, n=40):
    """n invented words, different for each k."""
    return " ".join(f"w{(k * 7919 + i * 104729) % 99991}x{'abcdefg'[(i + k) % 7]}" for i in range(n))


def inside(part, whole):
    """Whether a table's rows are among those of another."""
    return {str(r) for r in part.collect()} <= {str(r) for r in whole.collect()}
