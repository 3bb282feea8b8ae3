import numpy as np

from tessella.llm import arrays as A


def keys(words):
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    return A.hash_words(data, ends - size, ends)


def test_word_hashes_depend_on_the_bytes_alone():
    words = [b"", b"a", b"a\0", b"abcdefgh", b"abcdefghi", b"ghabcdef", b"x" * 40, b"x" * 41, b"b", b"a"]
    h = keys(words)
    assert len(set(h.tolist())) == len(set(words)) and h[1] == h[-1]
    assert keys(words[::-1]).tolist() == h[::-1].tolist()


def test_thue_morse_words_and_swapped_blocks_differ():
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    one, two = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    found = keys([one[:1024], two[:1024], one, two, b"abcdefgh12345678", b"12345678abcdefgh"])
    assert len(set(found.tolist())) == 6
