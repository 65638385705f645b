"""Jobs wired from readers, operators and writers."""
