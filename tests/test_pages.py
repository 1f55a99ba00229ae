import html

import pytest
from pyspark.sql import functions as F

from antecede.operators.pages import unescape


@pytest.mark.parametrize("text", ["Jos&#233; &eacute;t&eacute; &#xE9; &quot;x&quot; &amp;lt; a & b &unknown; &#128512;", "plain", "", "&&amp;&", "a&nbsp;b\n&copy;"])
def test_character_references(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(unescape(F.col("t"))).first()[0] == html.unescape(text)
