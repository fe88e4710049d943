"""Views that give the driver tables the shape of mails, documents and notices.

The SQL is valid in Spark and DuckDB; both sides of a check may start here.
"""

VIEWS = {
    "fx_ship": """
SELECT o.o_orderkey AS k, CAST(o.o_orderkey % 50 AS INT) AS f, o.o_orderdate AS received_at,
  upper(s.s_name) || ' SDN BHD' AS shipper, upper(c.c_name) || ' PTE LTD' AS consignee,
  ns.n_name || ', ORIGIN' AS pol, nc.n_name || ', DEST' AS pod,
  translate(lpad(CAST(ns.n_nationkey AS STRING),5,'0'),'0123456789','ABCDEFGHIJ') AS pol_code,
  translate(lpad(CAST(nc.n_nationkey AS STRING),5,'0'),'0123456789','KLMNOPQRST') AS pod_code,
  l.boxes, l.kg
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation nc ON nc.n_nationkey = c.c_nationkey
JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, CAST(count(*) AS INT) AS boxes,
             CAST(sum(l_quantity) AS BIGINT) * 100 AS kg FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON s.s_suppkey = l.sk JOIN nation ns ON ns.n_nationkey = s.s_nationkey
""",
    "fx_docs": """
SELECT k, 'email_' || CAST(k AS STRING) AS email_id, 'SI' AS doc_type,
  'attachments/email_' || CAST(k AS STRING) || '_SI.txt' AS path,
  'SHIPPING INSTRUCTION' || chr(10) || '=====' || chr(10) || 'Shipper: ' || shipper || chr(10) || '  WAREHOUSE 5; PORT ROAD' || chr(10)
  || 'Consignee (Non-Negotiable): ' || consignee || chr(10) || 'Notify: ' || consignee || chr(10)
  || 'Port of Loading (POL): ' || pol || ' (' || pol_code || ')' || chr(10) || 'POD: ' || pod || ' (' || pod_code || ')' || chr(10)
  || 'Total Containers: ' || CAST(boxes AS STRING) || ' x 40''HC' || chr(10) || 'Gross Wt (kgs): ' || CAST(kg AS STRING) || ' KG' || chr(10)
  || 'Booking Ref: BKG' || lpad(CAST(k AS STRING),8,'0')
  || CASE WHEN f % 3 = 0 THEN chr(10) || 'ETD: 2026-03-' || lpad(CAST(1 + f % 28 AS STRING),2,'0') ELSE '' END || CASE WHEN f % 7 = 0 THEN chr(10) || 'ETA: 2026-04-15' ELSE '' END AS text
FROM fx_ship WHERE f < 15 OR f > 30
UNION ALL
SELECT k, 'email_' || CAST(k AS STRING), 'BL', 'attachments/email_' || CAST(k AS STRING) || '_BL.txt',
  CASE WHEN f = 9 THEN '' ELSE
  CASE WHEN f = 8 THEN 'PACKING LIST' ELSE 'BILL OF LADING (DRAFT)' END || chr(10)
  || CASE WHEN f = 13 THEN 'Shipper | ' ELSE 'Exporter: ' END || CASE WHEN f = 6 THEN replace(shipper,'SUPPLIER','SUPPLIEQ') ELSE shipper END || chr(10)
  || 'CONSIGNEE: ' || CASE WHEN f = 3 THEN 'OTHER BUYER HOUSE' ELSE consignee END || chr(10)
  || 'Notify Party: ' || CASE WHEN f = 5 THEN 'TBA' ELSE consignee END || chr(10)
  || CASE WHEN f = 14 THEN 'Load Port' || chr(10) || '  ' ELSE 'Load Port: ' END || pol || ' (' || pol_code || ')' || chr(10)
  || 'Discharge Port: ' || pod || CASE WHEN f = 4 THEN '' ELSE ' (' || pod_code || ')' END || chr(10)
  || 'No. of Containers: ' || CASE WHEN f = 1 THEN CAST(boxes + 1 AS STRING) || ' x 40HC' WHEN f = 12 AND boxes > 1 THEN '1x40HC + ' || CAST(boxes - 1 AS STRING) || 'x20GP' ELSE CAST(boxes AS STRING) || ' x 40HC' END || chr(10)
  || 'Gross Weight: ' || CASE WHEN f = 2 THEN CAST(kg + 500 AS STRING) || ' KG' WHEN f = 7 THEN CAST(kg / 1000 AS STRING) || ' MT' ELSE CAST(kg AS STRING) || ' KGS' END
  || CASE WHEN f % 6 = 0 THEN chr(10) || 'ETD: ' || lpad(CAST(1 + f % 28 AS STRING),2,'0') || '/03/2026' WHEN f % 4 = 1 THEN chr(10) || 'ETD: 2026-03-30' ELSE '' END || CASE WHEN f % 14 = 0 THEN chr(10) || 'ETA: 2026-04-16' ELSE '' END END
FROM fx_ship WHERE (f < 15 OR f > 30) AND f NOT IN (10, 11)
""",
    "fx_emails": """
SELECT k, 'email_' || CAST(k AS STRING) AS email_id,
  CASE WHEN f BETWEEN 28 AND 30 THEN 'winner@secure-mailbox.org' WHEN k % 10 = 0 THEN 'docs@hub.example'
       WHEN k % 10 = 1 THEN 'Ops Desk <Ops@Example.com>' ELSE 'client' || CAST(k % 40 AS STRING) || '@partner' || CAST(k % 7 AS STRING) || '.com' END AS sender,
  CASE WHEN f BETWEEN 15 AND 19 THEN 'RE: Fwd: SI needed for SHP-' || lpad(CAST(k AS STRING),6,'0')
       WHEN f BETWEEN 20 AND 24 THEN 'Outstanding invoice and demurrage' WHEN f BETWEEN 25 AND 27 THEN '_Reminder_ daily berthing update'
       WHEN f BETWEEN 28 AND 30 THEN 'Congratulations winner, act now' ELSE 'TO CONFIRM DOCS _ SHP-' || lpad(CAST(k AS STRING),6,'0') END AS subject,
  CASE WHEN f = 10 THEN 'Please compare the SI and draft BL and confirm (attachments appear to have been dropped).'
       WHEN f = 11 THEN 'Please assist to send the draft BL for checking asap.'
       WHEN f BETWEEN 28 AND 30 THEN 'Click here, guaranteed.' WHEN f BETWEEN 15 AND 27 THEN 'Kindly see subject.'
       ELSE 'Attached are the SI and draft BL. Please check and confirm.' END AS body,
  CASE WHEN f IN (10, 11) THEN 'attachments/email_' || CAST(k AS STRING) || '_SI.txt'
       WHEN f < 15 OR f > 30 THEN 'attachments/email_' || CAST(k AS STRING) || '_SI.txt|attachments/email_' || CAST(k AS STRING) || '_BL.txt'
       ELSE '' END AS attachments_csv, received_at
FROM fx_ship
""",
    "fx_gold": """
SELECT 'email_' || CAST(k AS STRING) AS email_id,
  CASE WHEN f BETWEEN 15 AND 19 THEN 'SI_REQUEST' WHEN f BETWEEN 20 AND 24 THEN 'INVOICE_QUERY' WHEN f BETWEEN 25 AND 27 THEN 'GENERAL'
       WHEN f BETWEEN 28 AND 30 THEN 'SPAM' ELSE 'BL_COMPARISON' END AS category,
  CASE WHEN f IN (1,2,3) THEN 'MISMATCH' WHEN f IN (5,6,8,9,10) THEN 'NEEDS_REVIEW' WHEN f BETWEEN 15 AND 30 THEN 'SKIPPED' ELSE 'OK' END AS status,
  CASE f WHEN 5 THEN 'missing_value' WHEN 6 THEN 'possible_match' WHEN 8 THEN 'wrong_doc_type' WHEN 9 THEN 'unreadable' WHEN 10 THEN 'missing_attachment' END AS review_reason,
  CASE f WHEN 1 THEN 'container_count' WHEN 2 THEN 'gross_weight_kg' WHEN 3 THEN 'consignee' END AS defect_field
FROM fx_ship
""",
    "fx_revisions": """
SELECT event_id AS reg_id, 'REF:SHP-' || lpad(CAST(user_id + CASE WHEN user_id % 5 = 0 AND event_type = 'view' THEN 5000 ELSE 0 END AS STRING),4,'0') AS shipment_key,
  CASE event_type WHEN 'view' THEN 'SI' WHEN 'click' THEN 'BL' ELSE 'INVOICE' END AS doc_type,
  props AS content, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 7 = 0 THEN ts - INTERVAL '9' DAY ELSE ts END AS received_at, ts AS created_at
FROM events WHERE event_type IN ('view','click','purchase')
""",
    "fx_dispatches": """
SELECT k AS dispatch_id, 'STG-email_' || CAST(k AS STRING) AS stage_id, CASE WHEN k % 4 = 0 THEN NULL ELSE 'email_' || CAST(k AS STRING) END AS email_id,
  '<m' || CAST(k AS STRING) || '@hub>' AS message_id, 'client' || CAST(k % 40 AS STRING) || '@partner' || CAST(k % 7 AS STRING) || '.com' AS recipient,
  CASE k % 4 WHEN 0 THEN 'SIMULATED' WHEN 1 THEN 'SENT_SMTP' WHEN 2 THEN 'FAILED' ELSE 'SENT' END AS delivery, received_at AS created_at
FROM fx_ship
""",
    # What has been sent so far: most mails still wait for a reply.
    "fx_sent": """
SELECT * FROM fx_dispatches WHERE dispatch_id % 3 = 0
""",
    "fx_bounces": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' || CAST(event_id AS STRING) || '@hub' END AS original_message_id,
  CASE WHEN event_id % 3 = 1 THEN 'Undeliverable: Ref #STG-email_' || CAST(event_id AS STRING) ELSE 'Delivery failure' END AS subject,
  'client' || CAST(user_id % 40 AS STRING) || '@partner' || CAST(user_id % 7 AS STRING) || '.com' AS recipient,
  CASE event_id % 5 WHEN 0 THEN 'delayed' WHEN 1 THEN 'delivered' WHEN 2 THEN 'failed' ELSE '' END AS action,
  CASE event_id % 5 WHEN 3 THEN '5.1.1' WHEN 4 THEN '4.2.0' ELSE '' END AS status_code, ts AS received_at
FROM events WHERE event_type IN ('error','signup')
""",

    # Values in the layouts documents print them.
    "fx_measures": """
SELECT p_partkey AS id, CASE CAST(p_partkey % 12 AS INT)
  WHEN 0 THEN CAST(p_size AS STRING) || ' x 40''HC'
  WHEN 1 THEN '1x40HC + ' || CAST(p_size AS STRING) || 'x20GP'
  WHEN 2 THEN 'ABCU' || lpad(CAST(p_partkey AS STRING),7,'0')
  WHEN 3 THEN CAST(p_size AS STRING) || ' containers'
  WHEN 4 THEN CAST(p_size AS STRING) || ',' || lpad(CAST(p_partkey % 1000 AS STRING),3,'0') || '.50 KGS'
  WHEN 5 THEN CAST(p_size AS STRING) || '.5 MT'
  WHEN 6 THEN CAST(p_size AS STRING) || ' 058 KG'
  WHEN 7 THEN 'ABOUT ' || CAST(p_size AS STRING) || '000 KG'
  WHEN 8 THEN CAST(p_size AS STRING) || '.234.567 kg'
  WHEN 9 THEN p_name
  WHEN 10 THEN CAST(p_size AS STRING) || 'x40HC and 2x20GP plus 1 x 45'
  ELSE CAST(p_size AS STRING) || 'O' || CAST(p_size AS STRING) || ' tons' END AS raw
FROM part
""",
    "fx_dates": """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 9 AS INT)
  WHEN 0 THEN y || '-' || m || '-' || d
  WHEN 1 THEN d || ' ' || mon || ' ' || y
  WHEN 2 THEN mon || ' ' || d || ', ' || y
  WHEN 3 THEN d || '/' || m || '/' || y
  WHEN 4 THEN d || '.' || m || '.' || y || ' (est)'
  WHEN 5 THEN '31/02/' || y
  WHEN 6 THEN 'about ' || y || '/' || m || '/' || d || ' 10:30'
  WHEN 7 THEN 'TBA'
  ELSE lower(mon) || '. ' || d || ' ' || y END AS raw
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m,
        CAST(day(o_orderdate) AS STRING) AS d,
        substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(month(o_orderdate) AS INT) * 3 - 2, 3) AS mon FROM orders) q
""",
    "fx_names": """
SELECT 'C' || CAST(c_custkey AS STRING) AS id, CASE CAST(c_custkey % 5 AS INT)
    WHEN 0 THEN c_name || ' Sdn. Bhd.' WHEN 1 THEN c_name || ' PTE LTD; 12 Port Road' WHEN 2 THEN 'Notify: ' || c_name || ' | Tel 555'
    WHEN 3 THEN 'AB Co. Ltd' ELSE c_name || ', No 5 Main Street' END AS raw FROM customer
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING), CASE CAST(s_suppkey % 3 AS INT)
    WHEN 0 THEN s_name || ' FZ-LLC' WHEN 1 THEN s_name || ' on behalf of Others Inc' ELSE '  ' || s_name || '   GmbH  ' END FROM supplier
""",
    "fx_ports": """
SELECT 'K' || CAST(n_nationkey AS STRING) || '-' || CAST(s_suppkey AS STRING) AS id, CASE CAST(s_suppkey % 4 AS INT)
    WHEN 0 THEN n_name || ', ORIGIN (' || translate(lpad(CAST(n_nationkey AS STRING),5,'0'),'0123456789','ABCDEFGHIJ') || ')'
    WHEN 1 THEN 'POL: ' || lower(n_name) || ' port' WHEN 2 THEN '(' || 'KLMNO' || ') ' || n_name ELSE n_name || '  /  ' || n_name END AS raw
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""",

    # Attachment names in the spellings senders use.
    "fx_files": """
SELECT p_partkey AS id, CASE CAST(p_partkey % 16 AS INT)
  WHEN 0 THEN 'in/Shipping_Instruction_PO' || CAST(p_partkey AS STRING) || '.pdf' WHEN 1 THEN 'Draft_BL_v2.xlsx' WHEN 2 THEN 'SI_and_BL.pdf'
  WHEN 3 THEN 'invoice_' || CAST(p_partkey AS STRING) || '.pdf' WHEN 4 THEN 'x_SI_BL.txt' WHEN 5 THEN 'SHP-001_SI.frombody.txt'
  WHEN 6 THEN 'si.exe' WHEN 7 THEN 'SILVER LINING.pdf' WHEN 8 THEN 'inv-7.csv' WHEN 9 THEN 'BillOfLading copy.docx'
  WHEN 10 THEN 'commercial inv.doc' WHEN 11 THEN 'noext' WHEN 12 THEN p_name || '.pdf' WHEN 13 THEN 'MBL 77.TIFF'
  WHEN 14 THEN '../../' || p_name || '..si.json' ELSE 'a/b' || chr(92) || p_brand || '_bl_.zip' END AS name FROM part
""",
    # Mails whose wording reaches every classification rule.
    "fx_talk": """
SELECT 'T' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS email_id,
  CASE CAST((conv_id + turn) % 6 AS INT) WHEN 0 THEN 'Ann <ann@promo.example.org>' WHEN 1 THEN 'no-reply@accounts.google.com'
    WHEN 2 THEN 'no-spam.doc@shipper.com' WHEN 3 THEN 'x@spam.example' WHEN 4 THEN 'ops@partner.com' ELSE 'desk' END AS sender,
  CASE CAST((conv_id * 5 + turn) % 14 AS INT) WHEN 0 THEN 'Security Alert' WHEN 1 THEN 'Phishing attempt' WHEN 2 THEN 'free lottery: click here'
    WHEN 3 THEN 'Submit SI please' WHEN 4 THEN 'Shipping Instruction for order' WHEN 5 THEN 'bl draft to check' WHEN 6 THEN 'Invoice and payment, demurrage'
    WHEN 7 THEN 'Daily berthing report' WHEN 8 THEN 'hello' WHEN 9 THEN 'Draft B/L vs SI' WHEN 10 THEN 'kindly issue SI; payment outstanding'
    WHEN 11 THEN 'discount' WHEN 12 THEN 'Re: FW: AW: docs - Discrepancy Notice #4' ELSE '' END AS subject,
  CASE CAST((conv_id * 3 + turn) % 9 AS INT) WHEN 0 THEN 'Please send the draft BL today.' WHEN 1 THEN 'Kindly provide SI. Attachments are missing.'
    WHEN 2 THEN 'please compare the SI and the draft BL' WHEN 3 THEN 'Unsubscribe here' WHEN 4 THEN 'From: Joe <joe@Client.com>' || chr(10) || 'shipping instruction below'
    WHEN 5 THEN 'bill of lading text for ABC-123' WHEN 6 THEN 'see invoice charges' ELSE text END AS body,
  CASE CAST((conv_id + 2 * turn) % 7 AS INT) WHEN 0 THEN 'a_SI.txt|b_BL.pdf' WHEN 1 THEN 'Draft_BL_v2.xlsx' WHEN 2 THEN 'SHP-1_SI.frombody.txt|SI_v1.pdf|bl.docx'
    WHEN 3 THEN 'x_SI_BL.txt|si form.doc' WHEN 4 THEN 'photo.exe|invoice.pdf' WHEN 5 THEN 'GO-77_BL.txt' ELSE '' END AS attachments_csv
FROM conversations
""",
    "fx_all_mails": """
SELECT email_id, sender, subject, body, attachments_csv FROM fx_emails
UNION ALL SELECT email_id, sender, subject, body, attachments_csv FROM fx_talk
""",
    # Stored reports, with failed and retired runs mixed in.
    "fx_reports": """
SELECT s.k AS report_id, g.email_id, 'REF:SHP-' || lpad(CAST(s.k AS STRING),6,'0') AS shipment_key, g.category,
  CASE WHEN s.k % 37 = 0 THEN 'ERROR' WHEN s.k % 41 = 0 THEN 'DEAD_LETTER' ELSE g.status END AS status,
  CASE WHEN s.k % 37 = 0 OR s.k % 41 = 0 THEN NULL ELSE g.review_reason END AS review_reason,
  s.k % 37 <> 0 AND s.k % 41 <> 0 AND g.status = 'MISMATCH' AS has_defect,
  CASE WHEN s.k % 37 = 0 OR s.k % 41 = 0 THEN NULL ELSE g.defect_field END AS defect_field,
  CASE WHEN s.k % 29 = 0 THEN NULL ELSE 'rule-classifier' END AS classify_source,
  s.k % 11 = 0 AS reviewed, CAST(s.k % 5 AS INT) AS attempts, s.received_at AS updated_at, s.f, s.boxes, s.kg, s.shipper, s.consignee
FROM fx_ship s JOIN fx_gold g ON g.email_id = 'email_' || CAST(s.k AS STRING)
""",
    "fx_issues": """
SELECT report_id, email_id, shipment_key, defect_field AS field_name,
  CASE f WHEN 1 THEN CAST(boxes AS STRING) WHEN 2 THEN CAST(kg AS STRING) ELSE consignee END AS si_value,
  CASE f WHEN 1 THEN CAST(boxes + 1 AS STRING) WHEN 2 THEN CAST(kg + 500 AS STRING) ELSE 'OTHER BUYER HOUSE' END AS bl_value,
  CASE CAST(report_id % 6 AS INT) WHEN 0 THEN 'OPEN' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'SUPERSEDED' ELSE 'SUGGESTED' END AS status
FROM fx_reports WHERE defect_field IS NOT NULL
""",
    # Issues of which one side, or both, printed no value.
    "fx_half_issues": """
SELECT report_id, email_id, shipment_key, field_name, CASE WHEN report_id % 5 <> 0 THEN si_value END AS si_value, CASE WHEN report_id % 7 <> 0 THEN bl_value END AS bl_value, status
FROM fx_issues
""",
    # Mails whose verdict a run did not deliver: the scores have something to find.
    "fx_withheld": """
SELECT email_id FROM fx_emails WHERE k % 41 <= 1
""",
    # Configured policies of mailboxes, valid and not.
    "fx_policies": """
SELECT 'box' || CAST(c_custkey AS STRING) AS source_mailbox, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' WHEN 2 THEN 'sometimes' WHEN 3 THEN '' END AS mode
FROM customer
""",
    # Registered document revisions with a value to normalise.
    "fx_regs": """
SELECT reg_id, shipment_key, doc_type, 'email_' || CAST(reg_id AS STRING) AS email_id,
  'attachments/' || CAST(reg_id AS STRING) || '_' || doc_type || '.txt' AS filename, content, received_at, created_at,
  CASE WHEN length(content) > 8 THEN substr(content, 7, 1) END AS boxes
FROM fx_revisions
""",
    # Mails before ingestion.
    "fx_staged": """
SELECT e.k AS id, 'STG-' || e.email_id AS stage_id, e.email_id, CASE CAST(e.k % 4 AS INT) WHEN 0 THEN 'OPS' WHEN 1 THEN 'DOCS' WHEN 2 THEN 'BOOKING' ELSE 'FINANCE' END AS source_mailbox,
  e.sender, e.subject, e.body, CASE WHEN e.k % 17 = 0 THEN 'BLOCKED' ELSE 'CLEAN' END AS security_status, g.category,
  CASE WHEN e.k % 17 = 0 OR g.category = 'SPAM' THEN 'QUARANTINED' WHEN e.k % 3 = 0 THEN 'STAGED' WHEN e.k % 3 = 1 THEN 'APPROVED' ELSE 'AUTO_INGESTED' END AS status,
  e.received_at AS created_at
FROM fx_emails e JOIN fx_gold g ON g.email_id = e.email_id
""",

    # Attachment manifests: name, size and the first bytes in hex.
    "fx_manifest": """
SELECT p_partkey AS id, CASE CAST(p_partkey % 13 AS INT) WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'invoice.exe.pdf' WHEN 3 THEN 'run.BAT' WHEN 4 THEN 'c.txt'
    WHEN 5 THEN 'd.zip' WHEN 6 THEN 'e.tar' WHEN 7 THEN 'f.heic' WHEN 8 THEN '' WHEN 9 THEN 'g.eml' WHEN 10 THEN 'h.rtf' WHEN 11 THEN 'i.com' ELSE 'j.xlsx' END AS filename,
  CASE WHEN p_partkey % 31 = 0 THEN CAST(40000000 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 1000 END AS size,
  CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN '255044462D312E34' WHEN 1 THEN '504B030414000600' WHEN 2 THEN '4D5A900003' WHEN 3 THEN '7F454C4602' WHEN 4 THEN '0A255044462D31' WHEN 5 THEN '7B5C72746631'
    WHEN 6 THEN '0000001866747970686569' WHEN 7 THEN '46726F6D3A20610A' ELSE 'CAFEBABE00' END AS head FROM part
""",
    "fx_members": """
SELECT l_orderkey AS mail, l_linenumber AS pos, CASE WHEN l_linenumber = 3 THEN 'doc_1.pdf' WHEN l_linenumber = 5 THEN '../etc/x.pdf' WHEN l_linenumber = 6 THEN '__MACOSX/.f'
  ELSE 'in/doc_' || CAST(l_linenumber AS STRING) || '.pdf' END AS name, CAST(l_quantity AS BIGINT) * 260000 AS size, l_returnflag <> 'R' AS safe FROM lineitem
""",
    "fx_nested": """
SELECT l_orderkey AS mail, CAST(l_linenumber AS INT) AS pos, CAST(CASE l_linenumber WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 5 WHEN 7 THEN 5 END AS INT) AS parent,
  CASE WHEN l_linenumber IN (1, 2, 3, 5) THEN 'part_' || CAST(l_linenumber AS STRING) || '.zip' WHEN l_linenumber = 7 AND l_orderkey % 4 = 0 THEN '../doc.pdf' ELSE 'in/doc.pdf' END AS name,
  CAST(max(l_quantity) AS BIGINT) * 260000 AS size, l_linenumber IN (1, 2, 3, 5) AS container, min(l_returnflag) <> 'R' AS safe FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "fx_enriched": """
SELECT e.email_id, e.sender, e.subject, r.category, r.status, r.has_defect, coalesce(r.defect_field, '') AS defect_fields, r.reviewed, r.report_id, r.updated_at,
  CASE CAST(e.k % 3 AS INT) WHEN 0 THEN 'OPS' WHEN 1 THEN 'DOCS' ELSE 'BOOKING' END AS source_mailbox,
  CASE WHEN d.dispatch_id IS NOT NULL AND e.k % 3 = 0 THEN CASE d.delivery WHEN 'SENT' THEN 'sent' WHEN 'SENT_SMTP' THEN 'sent' WHEN 'FAILED' THEN 'failed' ELSE 'simulated' END
    WHEN r.status IN ('MISMATCH', 'NEEDS_REVIEW') THEN 'awaiting' ELSE 'none' END AS reply_state, e.k % 3 = 0 AS has_dispatch, CASE WHEN e.k % 5 = 0 THEN 'auto' ELSE 'manual' END AS disposition
FROM fx_emails e JOIN fx_reports r ON r.email_id = e.email_id JOIN fx_dispatches d ON d.dispatch_id = e.k
""",
    "fx_notices": """
SELECT event_id, subject, 'Reporting-MTA: dns; hub' || chr(10) || CASE WHEN original_message_id IS NOT NULL THEN 'Original-Message-ID: <' || original_message_id || '>' || chr(10) ELSE '' END
  || CASE WHEN event_id % 2 = 0 THEN 'Original-Recipient: rfc822; first@x.org' || chr(10) ELSE '' END || 'Final-Recipient: rfc822; <' || recipient || '>' || chr(10)
  || 'Action: ' || upper(action) || chr(10) || 'Status: ' || status_code || chr(10) || 'Diagnostic-Code: smtp; 550 no: user' AS block FROM fx_bounces
""",
}
