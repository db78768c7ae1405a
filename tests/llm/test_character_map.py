"""Offsets through a real compiled character map: the library's own NFKC rules, put into the public model."""

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from leadforge.llm import pieces

TEXTS = ["ﬁne ﬂuﬀy", "Ａｂｃ １２３", "a　b  c ", " lead and trail  ", "㍿ ½ x² ™", "été café", "한국어 각", "plain words", "\ttab\nline", "😀 ㎏ Ⅷ", "", "ﷺ end"]


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf"])
def test_normalisation_and_offsets(tmp_path, rule, trim):
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    rules, proto = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(own.serialized_model_proto())
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trim
    assert len(proto.normalizer_spec.precompiled_charsmap) > 100_000
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    model = pieces.Pieces(str(path))
    normal = sentencepiece.SentencePieceNormalizer(model_file=str(path))
    for text, ids in zip(TEXTS, model.encode(TEXTS)[0]):
        plain, align = model.normalise(text)
        want = normal.normalize(text)
        assert plain.decode() == want or plain.decode().replace("▁", " ") == want.replace("▁", " ")
        assert (align[1:] >= align[:-1]).all() and align[-1] == len(text.encode()) and len(align) == len(plain) + 1
        assert ids[4:-4] == b"".join(i.to_bytes(4, "little") for i in model.library.encode(text))
        starts, ends = model.spans(text, ids)
        assert (ends >= starts).all() and (starts[1:] == ends[:-1]).all() and (not text.strip() or ends[-1] == len(text.encode()))
    plain, align = model.normalise("ﬁne")
    at = plain.decode().index("fi")
    assert align[len(plain.decode()[:at].encode())] == 0 and align[len(plain.decode()[: at + 2].encode())] == 3
