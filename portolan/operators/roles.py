"""Which columns of a table play which role, read from the header alone."""

from __future__ import annotations

from collections.abc import Sequence

from portolan.functions.text import fold_name

# Header keywords per role, matched as substrings of the folded name.
ROLE_KEYWORDS = {
    "cliente": ("cliente", "consignat", "importador", "exportador"),
    "quantidade": ("qtd", "qtde", "qte", "quant", "container", "cont", "teus", "volumes"),
    "data": ("data", "mes", "ano", "periodo", "ano/mes", "ano_mes"),
    "porto": ("porto", "port", "terminal", "por/uf", "origem", "embarque", "destino"),
    "armador": ("armador", "shipping", "carrier"),
    "operacao": ("i/e", "importa", "exporta", "operacao", "operac"),
}

# The client columns an exact client filter looks at.
CLIENT_COLUMNS = ("CONSIGNATARIO FINAL", "CONSIGNATÁRIO", "NOME IMPORTADOR", "NOME EXPORTADOR", "DESTINATÁRIO", "REMETENTE")

# Header words that mark a loading port.
LOADING_WORDS = ("embarque", "origem")


def columns_with(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in fold_name(c) for w in words)]


def role_columns(columns: Sequence[str], role: str) -> list[str]:
    """Columns whose header carries a keyword of the role, in table order."""
    return columns_with(columns, ROLE_KEYWORDS[role])


def client_columns(columns: Sequence[str]) -> list[str]:
    known = [c for c in CLIENT_COLUMNS if c in columns]
    return known or role_columns(columns, "cliente")


def port_columns(columns: Sequence[str]) -> list[str]:
    return columns_with(columns, ("porto",))


def loading_port_columns(columns: Sequence[str]) -> list[str]:
    """Loading-port columns, or every port column when none is marked as one."""
    ports = port_columns(columns)
    return columns_with(ports, LOADING_WORDS) or ports
