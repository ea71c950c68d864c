"""The transaction view over the driver's ``events`` table (see FIXTURES.md); runs in both engines."""

TXN_SQL = """
SELECT
  event_id AS row_key,
  CASE WHEN event_id % 193 = 0 THEN NULL ELSE CAST(10000 + user_id AS STRING) END AS accountNumber,
  concat('cust-', CAST(user_id AS STRING)) AS customerId,
  CAST(CASE WHEN user_id % 10 = 9 THEN 0 ELSE 250 + (user_id % 10) * 250 END AS DOUBLE) AS creditLimit,
  CAST((event_id % 40) * 50 AS DOUBLE) AS availableMoney,
  CASE WHEN event_id % 211 = 0 THEN 'not-a-date'
       WHEN event_id % 5 = 0 THEN CAST(date_trunc('hour', ts) AS STRING)
       ELSE CAST(date_trunc('second', ts) AS STRING) END AS transactionDateTime,
  CASE WHEN event_id % 97 = 0 THEN -value ELSE value END AS transactionAmount,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('merchant_', CAST(event_id % 37 AS STRING)) END AS merchantName,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'CAN' ELSE 'US' END AS acqCountry,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'can' WHEN event_id % 5 = 0 THEN 'MEX' ELSE 'US' END AS merchantCountryCode,
  CASE event_id % 6 WHEN 0 THEN '02' WHEN 1 THEN '05' WHEN 2 THEN '09' WHEN 3 THEN '81' WHEN 4 THEN '90' ELSE '' END AS posEntryMode,
  CASE event_id % 4 WHEN 0 THEN '01' WHEN 1 THEN '08' WHEN 2 THEN '99' ELSE NULL END AS posConditionCode,
  event_type AS merchantCategoryCode,
  concat('202', CAST(4 + user_id % 4 AS STRING), '-', lpad(CAST(1 + user_id % 12 AS STRING), 2, '0'), '-01') AS currentExpDate,
  concat('20', CAST(18 + user_id % 7 AS STRING), '-', lpad(CAST(1 + user_id % 12 AS STRING), 2, '0'), '-15') AS accountOpenDate,
  CASE WHEN user_id % 8 = 0 THEN NULL ELSE concat('2023-', lpad(CAST(1 + user_id % 12 AS STRING), 2, '0'), '-20') END AS dateOfLastAddressChange,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(100 + user_id % 900 AS STRING) END AS cardCVV,
  CAST(100 + user_id % 900 + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS STRING) AS enteredCVV,
  lpad(CAST(user_id % 10000 AS STRING), 4, '0') AS cardLast4Digits,
  CASE WHEN event_type = 'purchase' THEN 'PURCHASE' WHEN event_type = 'error' THEN 'REVERSAL' ELSE 'ADDRESS_VERIFICATION' END AS transactionType,
  '' AS echoBuffer,
  CAST((user_id * 37) % 2000 AS DOUBLE) AS currentBalance,
  concat('city_', CAST(user_id % 12 AS STRING)) AS merchantCity,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('S', CAST(event_id % 9 AS STRING)) END AS merchantState,
  lpad(CAST(event_id % 100000 AS STRING), 5, '0') AS merchantZip,
  event_id % 2 = 0 AS cardPresent,
  '' AS posOnPremises,
  '' AS recurringAuthInd,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_id % 19 <> 0 END AS expirationDateKeyInMatch,
  CASE WHEN event_id % 223 = 0 THEN NULL ELSE (event_id % 11 = 0 OR (event_type = 'error' AND event_id % 3 = 0)) END AS isFraud
FROM events
"""
