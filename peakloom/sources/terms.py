"""Controlled-vocabulary terms that the readers and writers use."""

from __future__ import annotations

# Accessions of the public MS and IMS vocabularies.
POSITION_X, POSITION_Y, POSITION_Z = "IMS:1000050", "IMS:1000051", "IMS:1000052"
EXTERNAL_OFFSET, EXTERNAL_LENGTH, EXTERNAL_BYTES = "IMS:1000102", "IMS:1000103", "IMS:1000104"
GRID_X, GRID_Y, EXTENT_X, EXTENT_Y, PIXEL_X, PIXEL_Y = "IMS:1000042", "IMS:1000043", "IMS:1000044", "IMS:1000045", "IMS:1000046", "IMS:1000047"
OFFSET_X, OFFSET_Y = "IMS:1000053", "IMS:1000054"
LINESCAN_SEQUENCE, SCAN_PATTERN, SCAN_TYPE, LINE_DIRECTION = "IMS:1000401", "IMS:1000413", "IMS:1000480", "IMS:1000491"
MICROMETRE = "UO:0000017"
IBD_UUID, IBD_SHA1, IBD_MD5, IBD_SHA256 = "IMS:1000080", "IMS:1000091", "IMS:1000090", "IMS:1000092"
CONTINUOUS, PROCESSED = "IMS:1000030", "IMS:1000031"
MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY = "MS:1000514", "MS:1000515", "MS:1000595"
FLOAT_32, FLOAT_64, ZLIB, NO_COMPRESSION = "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000576"
MS_LEVEL, CENTROID, PROFILE = "MS:1000511", "MS:1000127", "MS:1000128"
SCAN_START, MINUTE, SECOND = "MS:1000016", "UO:0000031", "UO:0000010"
NUMPRESS_LINEAR, NUMPRESS_PIC, NUMPRESS_SLOF = "MS:1002312", "MS:1002313", "MS:1002314"
#: The same, compressed by zlib in turn.
NUMPRESS_LINEAR_ZLIB, NUMPRESS_PIC_ZLIB, NUMPRESS_SLOF_ZLIB = "MS:1002746", "MS:1002747", "MS:1002748"
#: Compressions of the vocabulary that aren't read: truncation with zlib, alone, with delta and with linear prediction.
OTHER_COMPRESSION = ("MS:1003088", "MS:1003089", "MS:1003090")
ISOLATION_TARGET, SELECTED_MZ, CHARGE = "MS:1000827", "MS:1000744", "MS:1000041"
ISOLATION_LOWER, ISOLATION_UPPER, COLLISION_ENERGY = "MS:1000828", "MS:1000829", "MS:1000045"
INTEGER_32, INTEGER_64 = "MS:1000519", "MS:1000522"
MS1_SPECTRUM, MSN_SPECTRUM, MASS_SPECTRUM = "MS:1000579", "MS:1000580", "MS:1000294"
CONVERSION, CUSTOM_SOFTWARE = "MS:1000544", "MS:1000799"
