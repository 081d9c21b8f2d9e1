"""Compatible forms of characters (NFKC): in columns where a text can't have any other, by Unicode's own table elsewhere."""

from __future__ import annotations

from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of these characters only are their own NFKC form: ASCII, Latin letters that are whole, kana, CJK ideographs, their usual punctuation. Texts of ASCII only are told first and sooner.
PLAIN = r"^[\x00-\x7F]*+$|^[\x00-\x7F¡-§©«-®°±¶·»¿-ı‐‒-‖‘-‣‰、-〩ぁ-ゔァ-ヾ一-鿿]*+$"


@F.pandas_udf(StringType())
def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """The NFKC form; only texts that may have another one go to Python, as batches."""
    return F.coalesce(F.when(text.rlike(PLAIN), text), _normal(F.when(~text.rlike(PLAIN), text)))
