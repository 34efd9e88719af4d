"""Word lists that define features."""

from __future__ import annotations

# Function words in slot order. "nor" and "then" hold two slots each, so
# a profile of slots weighs them twice; distinct_words() gives the profile without that.
FUNCTION_WORDS = """
a an the i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves who whom whose which what that this these those
one ones in on at by for with about against between into through during before after above below to from up down out off
over under of unto upon and but or nor yet so if then because although while whereas when where be is am are was were been being
have has had having do does did doing will would shall should may might must can could not no never neither nor
now then here there how all each every both few more most other some any such only also very just even
again ever still already ye thee thou thy thine thyself hath doth didst hast art wilt shalt wherefore therefore thus hence
yea nay verily lest except save whoso whosoever whatsoever forth hither thither whither
""".split()


def distinct_words(words: list[str]) -> list[str]:
    """``words`` without repeats, in order of their first slot."""
    return list(dict.fromkeys(words))


def last_slots(words: list[str]) -> dict[str, int]:
    """The slot a word counts for when a repeated word keeps only its last slot, as in an index built by assignment."""
    return {w: i for i, w in enumerate(words)}
