"""Generated URL/href strings for parity tests against urllib.parse."""
import random

_PIECES = ["http:", "https:", "HTTP:", "ftp:", "mailto:", "javascript:", "data:", "tel:", "file:",
           "//", "/", "./", "../", "..", ".", "a", "b/", "c;p", "?q=1", "#f", "#", "?", ";x",
           "www.h.com", "h.com:443", "user:pw@h.com", "[::1]", "[fe80::1", "[abc]", "[1:2:3:4:5:6:7:8]", "[::ffff:1.2.3.4]", "[v1.x]", "[1.2.3.4]", "[::1%eth0]", "]", "10.0.0.1", "localhost",
           " ", "\t", "\n", "\x01", " ", "x y", "%20", "@", ":", "é", "|", "v10.2", "127.0.0.1"]
BASES = ["https://www.h.com/a/b/c.html?x=1#top", "http://h.com", "http://h.com/", "https://h.com/dir/",
         "http://ththre.example.com/fr/825?page=2&ref=x", "https://m.x.net/en/25#top", "http://h.com/a;p?q",
         "", "ftp://f.org/x/y", "http://[::1]:80/p"]


def gen(n, seed=7):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = r.randint(1, 5)
        out.append("".join(r.choice(_PIECES) for _ in range(k)))
    return out
