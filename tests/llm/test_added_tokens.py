"""The packing's ids against the tokenizers library as the file configures it, added tokens included."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from weekgrid.llm import packing, queries

END = "<|endoftext|>"
TEXTS = [f"one document{END}another", END, f"{END}{END} \n", f"  spaces {END}  {END}\n\n behind", "<|endoftext|", f"it's{END}'s é世{END}", "plain text", "", f"long words {END}" * 700]


def test_added_tokens(spark):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = packing.document_pieces(df, P.path("byte_bpe_50k.tiktoken"), queries.PATTERN).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*own.encode(t, add_special_tokens=False).ids, packing.CLOSING]
        assert (50256 in ids) == (END in t)
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found) == want
