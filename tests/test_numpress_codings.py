"""mzML arrays in every Numpress coding, and those that must fail."""

import base64
import struct
import zlib

import numpy as np
import pytest

from peakloom.functions.numpress import decode_pic, encode_linear, nibbles_of
from peakloom.sources import terms, xml
from tests.test_domain import term

MZ, INTENSITY = np.array([100.0, 101.5, 103.25, 110.0]), np.array([0.0, 7.0, 300.0, 70000.0])


def slof(values, scale=5000.0):
    return struct.pack(">d", scale) + (np.log(values + 1) * scale + 0.5).astype("<u2").tobytes()


def pic(values):
    half = [h for v in values for h in nibbles_of(int(v))]
    half += [0] * (len(half) % 2)
    return bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))


def read(spark, path, mz_term, mz, intensity_term, intensity, length=4, own=""):
    def one(kind, coding, data):
        return f"<binaryDataArray{own}>{term(kind)}{term(terms.FLOAT_64)}{term(coding)}<binary>{base64.b64encode(data).decode()}</binary></binaryDataArray>"

    arrays = one(terms.MZ_ARRAY, mz_term, mz) + one(terms.INTENSITY_ARRAY, intensity_term, intensity)
    path.write_text(f'<mzML><run><spectrumList><spectrum index="0" id="s" defaultArrayLength="{length}"><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum></spectrumList></run></mzML>')
    return xml.read_mzml(spark, str(path)).first()


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("coding", ["pic", "slof"])
def test_numpress_codings(spark, tmp_path, coding, packed):
    pack = zlib.compress if packed else bytes
    plain, deflated = {"pic": (terms.NUMPRESS_PIC, terms.NUMPRESS_PIC_ZLIB), "slof": (terms.NUMPRESS_SLOF, terms.NUMPRESS_SLOF_ZLIB)}[coding]
    data = {"pic": pic, "slof": slof}[coding](INTENSITY)
    got = read(spark, tmp_path / "a.mzML", terms.NUMPRESS_LINEAR_ZLIB if packed else terms.NUMPRESS_LINEAR, pack(encode_linear(MZ)), deflated if packed else plain, pack(data))
    assert got["mz"] == pytest.approx(MZ, rel=1e-7) and got["intensity"] == pytest.approx(INTENSITY, rel=0 if coding == "pic" else 3e-4)


def test_pic_by_hand():
    assert decode_pic(b"\x88").tolist() == [0, 0] and decode_pic(b"\x71\x88").tolist() == [1, 0, 0]
    for values in ([], [0], [1, 0], [15, 16, 0], [2**31, 2**32 - 1, 5]):
        assert decode_pic(pic(values)).tolist() == values


def test_unknown_codings_and_lengths_fail(spark, tmp_path):
    good = MZ.tobytes()
    assert read(spark, tmp_path / "a.mzML", terms.NO_COMPRESSION, good, terms.NO_COMPRESSION, good)["mz"] == MZ.tolist()
    assert read(spark, tmp_path / "b.mzML", terms.NO_COMPRESSION, good, terms.NO_COMPRESSION, good, 9, ' arrayLength="4"')["mz"] == MZ.tolist()
    with pytest.raises(Exception, match="compression MS:1003089"):
        read(spark, tmp_path / "c.mzML", terms.NO_COMPRESSION, good, "MS:1003089", good)
    with pytest.raises(Exception, match="4 values, not 5"):
        read(spark, tmp_path / "d.mzML", terms.NO_COMPRESSION, good, terms.NO_COMPRESSION, good, 5)
