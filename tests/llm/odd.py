"""Names of columns that the operators use themselves, and words that are hard to tell apart."""

CLASH = "id row blk bucket score kept kept_text removed rep key set_key component comp predicted lang_pred spans salt piece words rule"


def switched(size, first="a", second="b"):
    """The Thue-Morse word of a size and its complement: equal under any polynomial modulo a power of two, if long."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join((first, second)[b] for b in bits), "".join((second, first)[b] for b in bits)
