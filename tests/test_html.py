import time
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from eventloom.functions.html import DROPPED, read_page
from eventloom.operators import pagetext

CASES = [
    ("<html><body><p>a</p> <p> b </p></body></html>", "a\nb"),
    ("<title>t</title><p>x</p>", "t\nx"),  # no body: everything
    ("<head><title>t</title></head><body>x</body>", "x"),
    ("<body>out<main>in <b>bold</b></main>out</body>", "in\nbold"),
    ("<body><header>kept</header><nav>gone</nav><footer>gone</footer>y</body>", "kept\ny"),
    ("<body><script>var t='</p>';</script><style>p{}</style><noscript>n</noscript><svg><text>s</text></svg>z</body>", "z"),
    ("<body><a href='/x'>Link <b>text</b></a></body>", "Linktext [/x]"),
    ("<body><a href='/x'></a></body>", "[/x]"),
    ("<body><a href='#top'>up</a><a href='javascript:go()'>js</a><a>bare</a><a href=''>e</a></body>", "up\njs\nbare\ne"),
    ("<body><a href='/o'>outer<a href='/i'>inner</a></a></body>", "outerinner [/o]"),
    ("<body>one<p><b>two<p>three</body>", "one\ntwo\nthree"),  # unclosed tags
    ("<body>a<nav>b<p>c", "a"),  # an unclosed dropped tag swallows the rest
    ("<body>a<!-- c -->b</body>", "a\nb"),
    ("<body>x &amp; y &copy; &nope; &#65;&#x42;&#150;</body>", "x & y © &nope AB–"),
    ("<body>a<br>b<br/>c</br>d<img src=x>e</body>", "a\nb\nc\nd\ne"),
    ("<body>a</div>b</body>", "a\nb"),
    ("<body><template>t</template><ruby>r<rt>x</rt></ruby></body>", "r"),
    ("<a href='/m'><main>m</main></a><body>b</body>", "b"),
    ("", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_text(html, text):
    assert read_page(html)[0] == text


def test_counts_and_root():
    _, counts, root = read_page("<body><script></script><img><img><header>h</header><nav><main>m</main></nav></body>")
    assert counts == [1, 0, 1, 0, 1, 0, 0, 2] and root == "main"


def test_dropped_tags_leave_no_text():
    page = "".join(f"<{t}>secret</{t}>" for t in sorted(DROPPED - {"img"}))
    assert "secret" not in read_page(f"<body>{page}ok</body>")[0]


def test_deep_pages_are_linear():
    began = time.monotonic()
    text, *_ = read_page("<body>" + "<b>x" * 200_000)
    assert text.count("x") == 200_000 and time.monotonic() - began < 5


def test_a_batch_of_pages_is_read_bit_by_bit():
    """What Python holds at once does not grow with the pages of an Arrow batch."""
    fields = [T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())]
    frame = SimpleNamespace(schema=T.StructType(fields), mapInArrow=lambda read, schema: read)
    read = pagetext.read_html(frame)
    batch = pa.RecordBatch.from_pydict({"page_id": range(1001), "html": [f"<body>{i}{'x' * 30_000}</body>" for i in range(1000)] + [None]})
    tracemalloc.start()
    ids, texts = [], []
    for part in read(iter([batch])):
        ids += part.column("page_id").to_pylist()
        texts += [text.rstrip("x") for text in part.column("raw_text").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(1001)) and texts == [*map(str, range(1000)), ""]
    assert peak < 20_000_000
