"""Prompt wording in SQL."""

from __future__ import annotations

from ledgerloom.operators.prompts import ANSWER_TEXT, PLAIN_ANSWER_TEXT, SYSTEM_TEXT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FEW_SHOT = """string_agg('- text: ' || text || chr(10) || '  nominal: ' || nominal || chr(10) || '  department: ' || department
  || chr(10) || '  tax_code: ' || tax_code || chr(10) || '  similarity: ' || printf('%.2f', similarity), chr(10) ORDER BY rank)"""


def _list(column: str, table: str, first: str = "") -> str:
    return f"(SELECT string_agg(x, {quoted(', ')} ORDER BY x) FROM (SELECT DISTINCT {column} AS x FROM {table} ORDER BY 1 {first}))"


def _python_list(column: str, table: str) -> str:
    return f"(SELECT '[''' || string_agg(x, ''', ''' ORDER BY x) || ''']' FROM (SELECT DISTINCT {column} AS x FROM {table}))"


def _amount(value: str) -> str:
    return rf"regexp_replace(CAST(CAST({value} AS DECIMAL(38,6)) AS VARCHAR), '(\.\d+?)0+$', '\1')"


def chat(table: str) -> str:
    """Chat messages; every label is plain text without quotes."""
    return f"""SELECT query_id, {quoted(SYSTEM_TEXT)} AS system_prompt,
  'Code this invoice line.' || chr(10) || chr(10) || 'DETAIL: item ' || query_id || chr(10) || 'SUPPLIER: S' || (query_id % 7)
  || chr(10) || 'NET: ' || {_amount('query_id * 12345.125')} || chr(10) || 'VAT: ' || {_amount('query_id * 0.0005')} || chr(10) || chr(10) || 'Most similar past lines:' || chr(10)
  || {FEW_SHOT} || chr(10) || chr(10) || 'NOMINAL may be one of: ' || {_python_list('nominal', table)}
  || chr(10) || 'DEPARTMENT may be one of: ' || {_python_list('department', table)}
  || chr(10) || 'TAX CODE may be one of: ' || {_python_list('tax_code', table)}
  || chr(10) || chr(10) || {quoted(ANSWER_TEXT)} AS user_prompt
FROM knn JOIN {table} USING (idx) GROUP BY query_id"""


def plain(table: str) -> str:
    return f"""SELECT query_id, 'Code an invoice line.' || chr(10) || chr(10) || 'Labels:' || chr(10) || 'NOMINAL: '
  || {_list('nominal', table, 'LIMIT 10')} || '...' || chr(10) || 'DEPARTMENT: ' || {_list('department', table)}
  || chr(10) || 'TC: ' || {_list('tax_code', table)} || chr(10) || chr(10) || 'Similar past lines:' || chr(10)
  || string_agg('Example ' || rank || ': ' || substr(text, 1, 100) || '...' || chr(10) || '  NOMINAL: ' || nominal
                || ', DEPARTMENT: ' || department || ', TC: ' || tax_code, chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'The line to code:' || chr(10) || 'detail: item ' || query_id || chr(10) || chr(10)
  || {quoted(PLAIN_ANSWER_TEXT)} || chr(10) || 'NOMINAL: <label>' || chr(10) || 'DEPARTMENT: <label>' || chr(10) || 'TC: <label>' AS prompt
FROM knn JOIN {table} USING (idx) GROUP BY query_id"""
