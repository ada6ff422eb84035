"""Rows for the tests; in a module of its own, since every folder's ``conftest`` has the same name."""

# markup that a scanner blind to quotes, raw text or comments reads wrongly
PIECES = ['<a title="x > y" class="k">t</a>', "<img alt='1 > 0'>", "<p data-x='say \"a > b\"'>q</p>", "<div hidden/>after", "<i x=y/>bare",
          '<b a="1"b="2">', "<u ==odd>", "<s title = 'a > b' / >", "<em a = >", "<script>var a='<!--';if(a<b)c='</p>';</script>", "<!-- <script> -->",
          "<script src='x.js'/>kept", "<script-x>el</script-x>", "<style media='a>b'>p > q {}</style>", "<style-guide>g</style-guide>", "<SCRIPT>x</ script >",
          "<iframe src='a>b'>in <b>ner</b></iframe>", "<iframe src=x/></iframe>", "<iframe/>out", "</ p >", "</>", "</3 x>", "<!weird>", "<?pi x?>", "< lone", "a < b > c",
          "<p class='q r'>", "<p CLASS=bare>", "<p title=\"class='no'\" class=yes>", "<p data-class=z>", "<p class = \" lead  trail \">", "<p class>", "</p class='>'>x",
          "<!-- note -- >", "<br/><hr class='h'><meta content='>'>", "<wbr/>", "&lt;b title=&quot;1 &gt; 0&quot;&gt;", "<ul\tid=x\x0cclass=f>", "<img-gallery>", "<p x>n</p>",
          "<td a='1' b=\"2\" c=3 d>", "<x:y z:w='>'>", "tail"]


def odd_page(rng, other):
    body = "".join(rng.choice(PIECES) if rng.random() < 0.75 else other(rng) for _ in range(rng.randint(1, 12)))
    # what stays open reaches to the end of the page, so it comes last
    return f"<!DOCTYPE html><html><body>{body}" + rng.choice(["</body></html>", "", "<script>x<p>", "<p title='open", "<!-- open <b>c", "<a href=", "</di"])


def pages_df(spark, *htmls):
    rows = [(i, f"http://x.example/en/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")
