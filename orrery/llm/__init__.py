"""Operations on training text. Nothing outside this subpackage imports it."""
