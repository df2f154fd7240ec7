"""Byte codecs of the chunk format, as plain functions; timegrid.functions.udfs makes them callable from SQL."""
