"""peakloom: mass-spectrometry analytics expressed as Spark DataFrame operators."""
