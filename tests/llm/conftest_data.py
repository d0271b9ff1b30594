LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_words(text):
    """Lower-cased words of a text, by the book."""
    return (text or "").encode().translate(LOWER).split()
